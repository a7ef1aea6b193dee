import random

import pytest

from patternlake.llm.linededup import dedup, removals


def near(a, b):
    """Word edit distance of one at most."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(docs, min_words):
    import re

    lines = [((i is None, i or 0, n), tuple(re.findall(r"[^\x20\x09-\x0D]+", x))) for i, t in docs for n, x in enumerate((t or "").split("\n"))]
    used = [(p, w) for p, w in lines if w]
    by_length = {}
    for p, w in used:
        by_length.setdefault(len(w), []).append((p, w))
    far = lambda v, w: v == w or (min(len(v), len(w)) >= min_words and near(v, w))
    return {p for p, w in used if any(q < p and far(v, w) for n in (-1, 0, 1) for q, v in by_length.get(len(w) + n, ()))}


def corpus():
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcde") for _ in range(3))
    lines = [[word() for _ in range(n)] for n in [4, 7, 8, 8, 9, 15, 16, 17, 31, 32, 33, 64, 65, 12, 12]]
    for base in list(lines):
        for _ in range(4):
            new = list(base)
            for _ in range(rnd.choice([1, 1, 1, 2])):
                at, how = rnd.randrange(len(new)), rnd.randrange(3)
                new[at : at + (how != 0)] = [] if how == 2 else [word()]
            lines.append(new)
    lines += [[word() for _ in range(n)] for n in (1, 1, 2, 3, 4, 5, 6, 7, 7)]
    lines += [["x"] * 8, ["x"] * 9, ["x"] * 10, ["a", "b"] * 5, ["b", "a"] * 5]
    docs, places = {}, list(range(40))
    for line in lines * 2:
        docs.setdefault(rnd.choice(places), []).append(rnd.choice([" ", "  ", "\t"]).join(line) + rnd.choice(["", "\n", "\n \t"]))
    return [(i, "\n".join(x)) for i, x in docs.items()] + [(100, None), (101, ""), (None, " ".join(lines[6])), (102, "q " * 40_000 + "\n" + "q " * 40_001)]


@pytest.mark.parametrize("min_words,filter_rows", [(8, 1 << 21), (4, 2), (8, 0)])
def test_against_brute_force(spark, monkeypatch, min_words, filter_rows):
    from patternlake.llm import linededup

    monkeypatch.setattr(linededup, "_FILTER_ROWS", filter_rows)  # of the right size, crowded, and none
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS line", "3 AS key")
    got = {(r.doc_id is None, r.doc_id or 0, int(x)) for r in removals(df, min_words=min_words).collect() for x in r.removed.split(",") if x}
    want = plain(docs, min_words)
    assert got == want and len(want) > 40


def test_dedup_rewrites_texts(spark):
    line = "one two three four five six seven eight"
    rows = [(1, f"{line}\nshort one", 1), (2, f"head\n{line} nine\ntail", 2), (3, line, 3), (4, None, None), (5, "", 0), (6, f"{line}\n{line}", 6), (7, "short  one\n\nshort two", 7), (8, "head", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    df = df.selectExpr("*", *[f"'{k}' AS `{c}`" for k, c in enumerate(["id", "doc", "row", "removed", "every", "one", "kept", "new", "r_id", "_line", "_line_removed", "_line_all", "a.b c"])])
    out = dedup(df, chars_col="n_chars")
    assert out.columns == df.columns
    got = {r.doc_id: r for r in out.collect()}
    assert {i: (r.text, r.n_chars) for i, r in got.items()} == {1: (f"{line}\nshort one", 1), 2: ("head\ntail", 9), 4: (None, None), 5: ("", 0), 7: ("\nshort two", 10)}
    assert all([r[c] for c in out.columns[3:]] == [str(k) for k in range(13)] for r in got.values())
    assert {r.doc_id: (r.n_lines, r.n_removed, r.removed) for r in removals(df).collect()} == {1: (2, 0, ""), 2: (3, 1, "1"), 3: (1, 1, "0"), 4: (1, 0, ""), 5: (1, 0, ""), 6: (2, 2, "0,1"), 7: (3, 1, "0"), 8: (1, 1, "0")}


def test_repeated_ids_and_empty(spark):
    line = "one two three four five six seven eight"
    df = spark.createDataFrame([(1, line), (1, line), (1, f"a\n{line}"), (2, f"b\n{line}")], "doc_id long, text string")
    # Rows of one id are documents in the order of their texts' hashes; repeated rows are one.
    got = sorted((r.doc_id, r.n_lines, r.removed) for r in removals(df).collect())
    assert got in ([(1, 1, ""), (1, 1, ""), (1, 2, "1"), (2, 2, "1")], [(1, 1, "0"), (1, 1, "0"), (1, 2, ""), (2, 2, "1")])
    assert removals(df.filter("false")).collect() == [] and dedup(df.filter("false")).collect() == []
    with pytest.raises(ValueError):
        removals(df, min_words=2)


def test_null_ids_stay_apart(spark):
    import time

    rows = [(None, f"{k} a b c d e f g h i j\nsame short line\nunlike {k} {k * 7}") for k in range(10_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.time()
    got = removals(df).groupBy("n_removed").count().collect()
    took = time.time() - began
    assert {r.n_removed: r["count"] for r in got} == {0: 1, 1: 1, 2: 9_998} or {r.n_removed: r["count"] for r in got} == {0: 1, 2: 9_999}
    assert took < 60  # each row alone: an id's rows in one place took time with their square


def test_colliding_keys_hide_no_pair(spark, monkeypatch):
    """With hashes of two bits most keys collide; the words decide all the same."""
    from pyspark.sql import functions as F

    from patternlake.llm import linededup

    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    want = {(r.doc_id, r.removed) for r in removals(df).collect()}
    whole = F.shiftrightunsigned
    monkeypatch.setattr(linededup.F, "shiftrightunsigned", lambda c, n: whole(c, n + 38))
    assert {(r.doc_id, r.removed) for r in removals(df).collect()} == want
