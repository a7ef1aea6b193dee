import io
import random
import re
import sys

import pytest

from patternlake.functions import sql as S
from patternlake.operators import pattern_table_join, explode_matches, match_counts, pattern_anti_join, pattern_join, pattern_semi_join, top_matches
from patternlake.sources import cli, grep, grep_counts, read_tree
from patternlake.sources.files import files_with_match
from patternlake.streaming import windowed_counts


def test_tree_and_grep(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one fn\ntwo\nfn three\n")
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "deep" / "er" / "b.md").write_text("no\nFN\n\n")
    (tmp_path / "c.bin").write_bytes(b"fn\x00fn")
    # Its zero byte is beyond the first KiB.
    (tmp_path / "d.txt").write_bytes(b"x0" * 600 + b"\x00fn")
    (tmp_path / ".hidden").write_text("fn")
    (tmp_path / "empty.txt").write_text("")
    files = read_tree(spark, str(tmp_path))
    names = lambda df: sorted(r.path.rsplit("/", 1)[1] for r in df.collect())
    assert names(files) == ["a.txt", "b.md", "d.txt", "empty.txt"] and names(read_tree(spark, str(tmp_path), glob="*.md")) == ["b.md"] and "c.bin" in names(read_tree(spark, str(tmp_path), binary=True))
    assert sorted((r.path.rsplit("/", 1)[1], r.line_no, r.line) for r in grep(files, "fn", "i").collect())[:3] == [("a.txt", 1, "one fn"), ("a.txt", 3, "fn three"), ("b.md", 2, "FN")]
    assert {r.path.rsplit("/", 1)[1]: r.n for r in grep_counts(files, "^$").collect()} == {"a.txt": 0, "b.md": 1, "d.txt": 0, "empty.txt": 0}
    assert names(files_with_match(files, "two")) == ["a.txt"]


def test_command_line(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a1 b2\nc3\n")

    def run(*argv, text="a1 b2\nc3\n"):
        out = io.StringIO()
        return cli.run(spark, list(argv), io.StringIO(text), out), out.getvalue()

    assert run(r"\d") == (0, "1\n") and run("-g", r"\d") == (0, "1\n2\n3\n") and run("x") == (1, "") and run("(") == (2, "")
    assert run("-c", r"\d") == (0, "2\n") and run("-L", "C", "-i") == (0, "c3\n") and run("-r", "<$0>", r"\d") == (0, "a<1> b2\nc3\n") and run("-g", "-r", "", r"\d") == (0, "a b\nc\n")
    code, out = run("-c", r"\d", str(tmp_path))
    assert code == 0 and out.endswith("a.txt:2\n")


def test_operators(spark):
    df = spark.createDataFrame([(1, "x", "ab1 b22"), (2, "x", None), (3, "y", "none"), (4, "y", "b22 b22")], "id long, g string, t string")
    rows = explode_matches(df, "t", r"([a-z]+)(\d+)").orderBy("id", "ordinal").collect()
    assert [(r.id, r.ordinal, r.match, r.start, r.end, r.captures) for r in rows][:2] == [(1, 0, "ab1", 0, 3, ["ab", "1"]), (1, 1, "b22", 4, 7, ["b", "22"])] and len(rows) == 4
    assert {r.g: (r.texts, r.texts_with_match, r.matches) for r in match_counts(df, "t", r"\d+", ["g"]).collect()} == {"x": (2, 1, 2), "y": (2, 1, 2)}
    assert [(r.match, r.times) for r in top_matches(df, "t", r"\w+", 2).collect()] == [("b22", 3), ("ab1", 1)]
    patterns = {"digit": r"\d", "none": "none", "never": "zzz"}
    assert sorted((r.id, r.pattern_name) for r in pattern_join(df, "t", patterns).collect()) == [(1, "digit"), (3, "none"), (4, "digit")]
    assert sorted(r.id for r in pattern_semi_join(df, "t", patterns).collect()) == [1, 3, 4] and [r.id for r in pattern_anti_join(df, "t", patterns).collect()] == [2]
    table = spark.createDataFrame([(n, p) for n, p in patterns.items()] + [(f"p{k}", f"b{k}\\b") for k in range(2000)] + [("ab", "ab"), ("b2", "b2+$"), (None, "x"), ("x", None)], "name string, pattern string")
    got = pattern_table_join(df.withColumnRenamed("g", "pattern_name"), "t", table)
    assert got.columns == ["id", "pattern_name_", "t", "pattern_name"]
    found = sorted((r.id, r.pattern_name) for r in got.collect())
    texts = {1: "ab1 b22", 3: "none", 4: "b22 b22"}
    every = [(r.name, r.pattern) for r in table.dropna().collect()]
    assert found == sorted((i, n) for i, t in texts.items() for n, p in every if re.search(p, t)) and (1, "p22") in found and len(found) == 9
    assert pattern_table_join(df, "t", table.filter("false")).collect() == []
    assert pattern_semi_join(df, "t", {}).collect() == [] and pattern_join(df.filter("false"), "t", patterns).collect() == []


def test_pattern_table_repeats_no_text_in_python(spark):
    """A text with many patterns leaves the Python worker once, not once for each of them."""
    words = [f"word{k:03d}" for k in range(300)]
    df = spark.createDataFrame([(i, " ".join(words) + " ." * 300) for i in range(100)], "id long, t string").coalesce(1)
    table = spark.createDataFrame([(w, f"\\b{w}[a-z]?\\b") for w in words] + [(f"{w} {n}", f"{w}{n}") for w in words[:50] for n in (".*word299", "(?= )")], "name string, pattern string")
    got = pattern_table_join(df, "t", table)
    assert len(got.select("id", "pattern_name").collect()) == 100 * 400
    found = got.groupBy("pattern_name").count()
    assert {r["count"] for r in found.collect()} == {100}
    nodes, received = [found._jdf.queryExecution().executedPlan()], None
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "MapInArrow":
            received = node.metrics().apply("pythonDataReceived").value()
        for below in ("finalPhysicalPlan", "plan"):
            if node.nodeName() in ("AdaptiveSparkPlan", "ShuffleQueryStage", "TableCacheQueryStage", "BroadcastQueryStage") and (node.nodeName() == "AdaptiveSparkPlan") == (below == "finalPhysicalPlan"):
                nodes.append(getattr(node, below)())
        nodes += [node.children().apply(k) for k in range(node.children().size())]
    assert received < 4 * sum(len(r.t) for r in df.collect())


@pytest.mark.parametrize("without", [[], ["ahocorasick"], ["regex"]])
def test_pattern_table_equals_single_patterns(spark, without, monkeypatch):
    """Around every place of a literal the table decides as the pattern itself does on the whole text."""
    from pyspark.sql import functions as F

    from patternlake import functions as R
    from patternlake.operators import tables

    near = [
        "ab", r"\bab", r"ab\b", r"\bab[a-z]?\b", r"\Bab", r"ab\B", "[^a]ab", "ab[^b]", ".ab.", "ab.", r"\nab", r"ab\n", r"[\s\S]ab[\s\S]", "a?b?ab", "(?:b|ba)ab(?:a|ab){1,2}", r"(x|\b)ab(y|\b)(?:b\b)?", r"ab{2}\b",
        "(?m)^ab", "(?m)ab$", "(?m)^.ab.$", "(?s).ab.", "aab|", "[a-c&&[^b]]ab", r"\W{2}ab", r"(?:\bab ?){2,3}", "aa", "aba", "ba{0,3}?ab", "\U0001f600ab", "ab[\U0001f600x]", "(?u)ab.", "a[b]a", "(?<n>ab)b", "(a)(b)",
    ]
    whole = ["^ab", "ab$", "ab+", "(?i)ab", "(?=a)ab", r"(a)b\1", "ab.*ab", r"(?u)ab\p{L}", "[ab]", r"\p{Lu}ab"]
    patterns = []
    for p in near + whole:
        try:
            tables.compile_pattern(p)
            patterns.append(p)
        except ValueError:  # not of the dialect
            pass
    assert len(patterns) > 35 and sum(not tables._entry(0, tables.compile_pattern(p))[1].whole for p in patterns) > 25
    draw = random.Random(1)
    texts = sorted({"".join(draw.choices("aaabbb \nx_A.\U0001f600\u00e9", k=draw.randint(0, 7))) for _ in range(1500)} | {"ab", "", "xab", "abx", "\nab\n"})
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string").coalesce(1)
    table = spark.createDataFrame([(p, p) for p in patterns], "name string, pattern string")
    want = {(r.id, p) for r in df.select("id", F.filter(F.array(*[F.when(R.is_match("t", p), F.lit(p)) for p in patterns]), lambda x: x.isNotNull()).alias("ps")).collect() for p in r.ps}
    if not without:
        assert {(r.id, r.pattern_name) for r in pattern_table_join(df, "t", table).collect()} == want
        return
    # Without a module: the worker's part as it runs there, in this process.
    for name in without:
        monkeypatch.setitem(sys.modules, name, None)
    tables._matcher.cache_clear()
    literals: dict[str, list[tuple]] = {}
    for k, p in enumerate(patterns):
        literal, entry = tables._entry(k, tables.compile_pattern(p))
        literals.setdefault(literal, []).append(tuple(entry))
    always = [e[0] for e in literals.pop("", [])]
    search = tables._searcher(literals)
    for i, t in enumerate(texts):
        found, tried = search(t)
        own = {k for k, p in enumerate(patterns) if (i, p) in want}
        assert found <= own <= found | tried | {*always}
    tables._matcher.cache_clear()


def test_sql_functions(spark):
    S.register(spark, "t_words", "find_all", r"\w+'?")
    S.register(spark, "t_swap", "replace_all", r"(\w)(\d)", template="$2\\$1$$")
    S.register_table(spark, "t_matches", r"\d+")
    df = spark.createDataFrame([("ab1 'cd22'\nx9",), ("",), (None,), ("\n\n",)], "t string")
    df.createOrReplaceTempView("t_texts")
    from pyspark.sql import functions as F

    from patternlake import functions as R

    p = r"(?<w>[a-z]+)(\d+)'?"
    cases = {
        "find_from": (dict(start=2), R.find_from("t", p, 2)["match"]), "replace": (dict(template="1$w<$2>"), R.replace("t", p, "1$w<$2>")), "split": ({}, R.split("t", p)), "capture": (dict(group="w"), R.capture("t", p, "w")),
        "count_matching_lines": ({}, R.count_matching_lines("t", p)), "count": ({}, R.count("t", p)), "is_match": ({}, R.is_match("t", p)), "find": ({}, R.find_text("t", p)),
        "matching_lines": ({}, F.filter(F.split("t", "\n", -1), lambda x: R.is_match(x, p))),
    }
    for verb, (options, column) in cases.items():
        S.register(spark, "t_verb", verb, p, **options)
        got = spark.sql("SELECT t, t_verb(t) AS v FROM t_texts").collect()
        assert {str(r.t): r.v for r in got} == {str(r.t): r.v for r in df.select("t", column.alias("v")).collect()}, verb
    S.register(spark, "t_verb", "split", r"\d*")
    assert spark.sql("SELECT t_verb('a1b') AS v").first().v == ["", "a", "", "b", ""]
    assert spark.sql("SELECT t_words('it''s a') AS w").first().w == ["it'", "s", "a"]
    assert spark.sql("SELECT t_swap('a1') AS w").first().w == "1\\a$"
    assert [(r.ordinal, r.match) for r in spark.sql("SELECT * FROM t_matches('a1b22')").collect()] == [(0, "1"), (1, "22")]


def test_stream_equals_batch(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    found = windowed_counts(stream, "props", "ts", "7", width="6 hours", slide="3 hours", by=("event_type",))
    query = found.writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(100)
    assert sorted(map(str, spark.table("counted").collect())) == sorted(map(str, windowed_counts(events, "props", "ts", "7", width="6 hours", slide="3 hours", by=("event_type",)).collect()))
