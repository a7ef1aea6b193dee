import pytest

from patternlake.authoring import COMMON, PATTERNS, Builder, Composer, Macros, escape
from patternlake.authoring.lint import complexity, complexity_columns, has_errors, lint, lint_report
from patternlake.authoring.printers import dot, s_expression, statistics, tree
from patternlake.dialect import PatternError, compile_pattern
from patternlake.dialect.risk import assess


def test_builder():
    b = Builder().start_of_line().literal("a.b").start_group().digit().repeat_range(1, 3).or_().word().one_or_more().end_group().optional().whitespace().zero_or_more()
    assert b.build() == r"^a\.b(\d{1,3}|\w+)?\s*" and b.compile().group_count == 1
    c = Builder().char_class("ab").not_char_class("c").char_range("x", "z").any().repeat_exact(2).word_boundary().literal("q").repeat_at_least(1).end_of_line()
    assert c.build() == r"[ab][^c][x-z].{2}\bq{1,}$"
    assert Builder().literal("a").build() == "a"


def test_escape(spark):
    text = r"a.b^c$d*e+f?g(h)i[j]k{l}m|n\o"
    assert compile_pattern(f"^{escape(text)}$").exact_literal == (text, True, True)


def test_composer_and_macros():
    c = Composer().add("foo").add("bar")
    assert (c.alternatives(), c.sequence(), c.group()) == ("foo|bar", "foobar", "(foobar)")
    with pytest.raises(PatternError):
        Composer().alternatives()
    m = Macros(COMMON).define("pair", "${digit}x").define("digit", r"\d")
    assert m.expand("${digit}-${pair}") == r"\d-${digit}x" and m.expand("a${b") == "a${b" and m.is_defined("hex") and m.get("none") is None
    with pytest.raises(PatternError) as error:
        m.expand("${nope}")
    assert error.value.code == "UndefinedMacro"
    assert len(COMMON) == 13 and all(compile_pattern(p) for p in COMMON.values()) and len(PATTERNS) == 12


def test_lint():
    kinds = lambda p: [(w.level, w.type) for w in lint(p)]
    assert ("error", "catastrophic_backtracking") in kinds("(a+)+") and has_errors("x(b*)*") and not has_errors("(ab)+")
    assert ("warning", "empty_alternation") in kinds("(|a)") and ("warning", "redundant_quantifier") in kinds("a+*")
    assert ("warning", "excessive_nesting") in kinds("(" * 11 + ")" * 11) and ("warning", "complexity_warning") in kinds("()" * 21) and ("info", "complexity_warning") in kinds("a+" * 16)
    assert ("info", "optimization_opportunity") in kinds("^(a|b|c|d|e|f)") and kinds("^x") == []
    singles = lambda p: [w.suggestion for w in lint(p) if w.message.startswith("single")]
    assert singles("^x(p|q)(?:1|2|3)(ab|c)") == ["use [pq]", "use [123]"] and singles(r"^(\(|a)([a|b])") == []


def test_complexity_on_driver_and_in_columns(spark):
    patterns = ["abc", "((a+)|[b-c]*)?", "(" * 12 + "x" + ")" * 12, ")(", "", "é" * 30, "a|b|c(d)"]
    df = spark.createDataFrame([(p,) for p in patterns], "p string")
    rows = df.select("p", *[c.alias(k) for k, c in complexity_columns(df.p).items()]).collect()
    for r in rows:
        assert {k: r[k] for k in complexity(r.p)} == complexity(r.p)
    assert lint_report(spark, ["(a+)+", "ok"]).filter("level = 'error'").count() == 1


def test_risk_levels():
    level = lambda p: assess(compile_pattern(p).tree).level
    assert level("abc+") == "safe" and level("(?:ab|ab)c") in ("high", "critical") and level("(?:a?b?)?") in ("safe", "low")
    for good in (r"(?:\d+\.)+", r"(\p{L}+,)+", r"(?:[a-z]+-)*[a-z]+", r"(?:ab*c)*", "(?:\u4f60|\u597d)+", r"(?:a+b|c+d)*", r"(?i:a+B)*", r"(\w+\s)*", r"(?:[^,]+,)*", r"(?:x{2,5}){3}"):
        assert not compile_pattern(good).risk.above("medium"), good
    for overlapping in ("(?:a|ab|b)*", "(?:a|a)+", "(?i:a|A)*x", r"(?:\w|\d)+"):
        assert compile_pattern(overlapping).risk.above("medium"), overlapping
    for bad in ("(a+)+", "(?:a*)*", "(?:(?:a+)+)+", "(x+x+)+y", r"(\w+\d)*", "(a*b*)*", r"(?:[a-z]+\s?)+", "(?i:a+A)*", r"(?:\p{L}+x)*", r"(?:a{1,50})*", "(?:a|b+|ab)*"):
        with pytest.raises(PatternError):
            compile_pattern(bad)


def test_printers():
    p = compile_pattern(r"(?<y>\d{2,})(?:a|b)?^\1(?=c)")
    assert statistics(p)["groups"] == 2 and statistics(p)["quantifiers"] == 2 and statistics(p)["anchors"] == 1
    assert tree(p).splitlines()[0] == "concat" and "capture 1 y" in tree(p) and s_expression(p).startswith("(concat (capture 1 y")
    assert dot(p).count("->") == statistics(p)["nodes"] - 1
    assert p.describe()["names"] == {"y": 1}
    weight = lambda x: compile_pattern(x).describe()["complexity"]
    assert [weight(x) for x in ("abc", "[a-c]d", "a|b|c", "(ab)+", "a?", "a{2,4}", "(?=ab)", r"(a)\1", "")] == [3, 3, 5, 6, 2, 4, 10, 6, 1]
    assert compile_pattern(r"(?:\d+)+").describe()["warnings"] == ["nested quantifiers may take long"] and compile_pattern("a+b").describe()["warnings"] == []
    assert "find()" in compile_pattern("(?:(a)|b)*").describe()["warnings"][0] and any("HIGH" in w for w in compile_pattern("a|a").describe()["warnings"])


def test_simplify_keeps_matches(spark):
    from pyspark.sql import functions as F

    from patternlake.dialect.java import Emitter
    from patternlake.dialect.simplify import simplify

    cases = {"(?:a)": "a", "a{1}": "a", "(?:(?:a?)?)": "a?", "(?:a?)+": "a*", "b{0}a": "a", "(?:a|a)b": "ab", "(?:(?:ab))c": "abc", "(a)(?:)": "(a)"}
    texts = spark.createDataFrame([(t,) for t in ("", "a", "aab", "b", "abc", "cab")], "t string")
    for pattern, wanted in cases.items():
        before, after = compile_pattern(pattern), Emitter(simplify(compile_pattern(pattern).tree))
        assert len(after.text) <= len(before.java) and simplify(compile_pattern(wanted).tree) == simplify(before.tree), pattern
        rows = texts.select(F.regexp_extract_all("t", F.lit(before.java), F.lit(0)).alias("a"), F.regexp_extract_all("t", F.lit(after.text), F.lit(0)).alias("b")).collect()
        assert all(r.a == r.b for r in rows)


def test_unicode_columns(spark):
    from patternlake.functions import unicode as U

    df = spark.createDataFrame([("A",), ("é",), ("٣",), (" ",), ("_",), ("ab",), ("€",), (None,)], "c string")
    rows = df.select(U.general_category("c").alias("g"), U.is_letter("c").alias("l"), U.is_digit("c").alias("d"), U.is_alphanumeric("c").alias("n"), U.is_whitespace("c").alias("w"), U.matches_property("c", "Script=Latin").alias("s")).collect()
    assert [r.g for r in rows] == ["Lu", "Ll", "Nd", "Zs", "Pc", None, "Sc", None]
    assert [r[0] for r in df.select(U.script("c")).collect()] == ["Latin", "Latin", "Arabic", "Common", "Common", None, "Common", None]
    assert [(r.l, r.d, r.n, r.w, r.s) for r in rows[:4]] == [(True, False, True, False, True), (True, False, True, False, True), (False, True, True, False, False), (False, False, False, True, False)]


def test_observed_figures(spark):
    from patternlake.plans.profile import observed

    df, seen = observed(spark.createDataFrame([("a1",), ("b",), (None,), ("11",)], "t string"), "t", r"\d")
    assert df.count() == 4 and seen.get == {"texts": 4, "characters": 5, "texts_with_match": 2, "matches": 3}


def test_hints_and_cache():
    from patternlake.dialect import clear_cache

    p = compile_pattern("cat|dog|cow")
    assert p.first_characters == ("c", "d") and compile_pattern("ab+").first_characters == ("a",) and compile_pattern(r"\d").first_characters == ()
    clear_cache()
    assert compile_pattern("cat|dog|cow") is not p
