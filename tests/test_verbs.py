"""Hand-written cases of every verb, one plan per pattern."""

import pytest
from pyspark.sql import functions as F

from patternlake import functions as R
from patternlake.dialect import PatternError, compile_pattern
from patternlake.dialect.properties import BINARY

MATCH = [
    (r"\w+@\w+\.\w+", "", "user@example.com", True),
    (r"\w+@\w+\.\w+", "", "@example.com", False),
    (r"^\d{4}-\d{2}-\d{2}$", "", "2025-01-26", True),
    (r"^\d{4}-\d{2}-\d{2}$", "", "25-01-26", False),
    (r"^fn$", "", "fn\n", False),
    (r"abc\Z", "", "abc\n", False),
    (r"\Aabc\z", "", "abc", True),
    (r"^.$", "", "é", True),
    (r"^.$", "", "你", True),
    (r"^.$", "", "𐌀", False),
    (r"^.$", "", "\r", False),
    (r"^.$", "", " ", False),
    (r"^.$", "", "\x85", True),
    (r"^.$", "u", "𐌀", True),
    (r"^.$", "s", "\n", True),
    (r"(?i:[sdmt]|ll|ve|re)", "", "LL", True),
    (r"(?i:[sdmt]|ll|ve|re)", "", "Ve", True),
    ("K", "iu", "k", True),
    ("K", "iu", "K", True),
    (r"\s", "", " ", True),
    (r"\s", "", "﻿", True),
    (r"\S", "", "　", False),
    (r"\bé", "", "aé", True),
    (r"a\b", "", "aé", True),
    (r"[[:alpha:]]", "", "b", True),
    (r"[[:alpha:]]", "", ":", False),
    (r"[[:^digit:]]", "", "7", False),
    (r"[[a]", "", "[", True),
    (r"[a&&b]", "", "&", True),
    (r"[a-z&&[^b]]", "", "b]", True),
    (r"[[a-z]&&[^b]]", "v", "b", False),
    (r"[[a-z]--[b]]", "v", "c", True),
    (r"[[a-z]--[b]]", "v", "b", False),
    (r"^[\q{abc|x}y]$", "v", "abc", True),
    (r"[^]", "", "\n", True),
    (r"[]", "", "a", False),
    (r"\v", "", "\x0b", True),
    (r"\v", "", "\n", False),
    (r"\h\a", "", "ha", True),
    (r"\cj", "", "\n", True),
    (r"\0", "", "\x00b"[1:] + "\x00", True),
    (r"\101\x42C", "", "ABC", True),
    (r"\u{1F600}", "u", "😀", True),
    (r"a{", "", "a{", True),
    (r"x]}", "", "x]}", True),
    (r"(a)?b\1", "", "b", True),
    (r"(?<x>a)\k<x>", "", "aa", True),
    (r"\k<x>", "", "k<x>", True),
    (r"(?x) a b [ ] # c", "", "ab ", True),
    (r"\p{Lu}\p{Greek}\P{Uppercase_Letter}", "u", "Aαb", True),
    (r"\p{Script=Latin}+\p{White_Space}", "", "é ", True),
    (r"\p{ASCII}", "", "é", False),
    (r"\p{^Ll}", "", "a", False),
    (r"(?i)straSSe", "", "STRASSE", True),
    (r"É", "i", "é", True),
    (r"^(?:a|ab)(?:c|bcd)$", "", "abcd", True),
    (r"(?<!a)b", "", "ab", False),
    (r"(?<=ab+)c", "", "abbbc", True),
    (r"", "", "", True),
    (r"foo|bar", "", "xbar", True),
    (r"^start", "", "not start", False),
    (r"end$", "", "the end", True),
]


def evaluate(spark, cases, column):
    """The value of ``column(pattern, flags)`` for each (pattern, flags, text, ...) case."""
    got = {}
    for key in {(c[0], c[1]) for c in cases}:
        texts = [(k, c[2]) for k, c in enumerate(cases) if (c[0], c[1]) == key]
        df = spark.createDataFrame(texts, "k long, t string")
        for r in df.select("k", column(*key).alias("v")).collect():
            got[r.k] = r.v
    return [got[k] for k in range(len(cases))]


def test_is_match(spark):
    cases = [(p, f, t) for p, f, t, _ in MATCH]
    got = evaluate(spark, cases, lambda p, f: R.is_match("t", p, f))
    wrong = [(c, g) for c, g in zip(MATCH, got, strict=True) if g != c[3]]
    assert not wrong
    found = evaluate(spark, cases, lambda p, f: R.find("t", p, f))
    counts = evaluate(spark, cases, lambda p, f: R.count("t", p, f))
    every = evaluate(spark, cases, lambda p, f: R.find_all("t", p, f))
    for case, one, n, all_ in zip(MATCH, found, counts, every, strict=True):
        assert (one is not None) == case[3] == (n > 0), case
        assert n == len(all_), case
        if one is not None:
            assert (one.match, one.start, one.end) == (all_[0].match, all_[0].start, all_[0].end), case
            assert case[2][one.start : one.end] == one.match, case
            assert all(a.end <= b.start for a, b in zip(all_, all_[1:], strict=False))


FIND = [
    (r"(b+)(b*)", "", "abbbbbbbc", "bbbbbbb", 1, ["bbbbbbb", ""], [(1, 8), (8, 8)]),
    (r"(?:(?=(abc)))?a", "", "abc", "a", 0, ["abc"], [(0, 3)]),
    (r"(a)?(b)", "", "xxb", "b", 2, [None, "b"], [None, (2, 3)]),
    (r"(a)?(b)", "", "éxab!", "ab", 2, ["a", "b"], [(2, 3), (3, 4)]),
    (r"(x)|(y)$", "", "zy", "y", 1, [None, "y"], [None, (1, 2)]),
    (r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}", "", "[2025-01-26 14:30:45] User", "2025-01-26 14:30:45", 1, [], []),
    (r"a|ab", "", "abc", "a", 0, [], []),
    (r"ab|a", "", "abc", "ab", 0, [], []),
    (r"(?U:a+)", "", "aaa", "a", 0, [], []),
    (r"(?U:a+?)", "", "aaa", "aaa", 0, [], []),
    (r"(?:(?:(?<x>a)|(?<x>b)|c)\k<x>){1}", "", "bb", "bb", 0, [None, "b"], [None, (0, 1)]),
    (r"([^a]*)$", "", "aé", "é", 1, ["é"], [(1, 2)]),
    (r".*", "", "", "", 0, [], []),
    (r"(a)?ab", "", "xab", "ab", 1, [None], [None]),
    (r"(?:(a)b)*ac", "", "ababac", "ababac", 0, ["a"], [(2, 3)]),
    (r"x(?:y|(z+))(w)(?=(v))", "", "éxzzwv", "xzzw", 1, ["zz", "w", "v"], [(2, 4), (4, 5), (5, 6)]),
    (r"(?<=(é)x)(y)", "", "éxy", "y", 2, ["é", "y"], [(0, 1), (2, 3)]),
    (r"\d(-(\d)(-(\d))?)?;", "", "é1-2;", "1-2;", 1, ["-2", "2", None, None], [(2, 4), (3, 4), None, None]),
    (r"(x)(?!(y))\1", "", "xyxx", "xx", 2, ["x", None], [(2, 3), None]),
]


def test_find(spark):
    cases = [c[:3] for c in FIND]
    for unit in ("char", "byte"):
        for case, got in zip(FIND, evaluate(spark, cases, lambda p, f, u=unit: R.find("t", p, f, offsets=u)), strict=True):
            at = (lambda i, t=case[2]: i) if unit == "char" else (lambda i, t=case[2]: len(t[:i].encode()))
            assert (got.match, got.start, got.end) == (case[3], at(case[4]), at(case[4] + len(case[3]))), case
            assert got.captures == case[5], case
            assert [None if s is None else tuple(s) for s in got.capture_spans] == [None if s is None else (at(s[0]), at(s[1])) for s in case[6]], case


def test_find_from_keeps_context(spark):
    df = spark.createDataFrame([("aab ab",), (None,)], "t string")
    r = df.select(R.find_from("t", "b", 3).start.alias("a"), R.find_from("t", "^a", 1).alias("b"), R.find_from("t", r"(?<=a)b", 2).start.alias("c"), R.find_from("t", "a", 9).alias("d"), R.find_from("t", r"\bab", 1).start.alias("e")).collect()
    assert tuple(r[0]) == (5, None, 2, None, 4) and tuple(r[1]) == (None,) * 5
    with pytest.raises(ValueError):
        R.find_from("t", "a", -1)


FIND_ALL = [
    (r"\d{3}-\d{3}-\d{4}", "", "Call 555-123-4567 or 800-555-9876.", ["555-123-4567", "800-555-9876"]),
    (r"#\w+", "", "Loving #A programming! #opensource #systems", ["#A", "#opensource", "#systems"]),
    (r"<[a-z]+>", "", "<div>content<span>text", ["<div>", "<span>"]),
    (r"(?<=\s)\w+", "", "hello world foo bar", ["world", "foo", "bar"]),
    (r"a*", "", "baac", ["", "aa", "", ""]),
    (r"(?<=a)a", "", "aaa", ["a", "a"]),
    (r"\d+", "", "none", []),
    (r"^fn$", "m", "fn\nx\nfn", ["fn", "fn"]),
    (r"\bfn\b", "", "fn fnx xfn fn end", ["fn", "fn"]),
    (r"^a", "m", "a\rab\na", ["a", "a"]),
]


def test_find_all(spark):
    cases = [c[:3] for c in FIND_ALL]
    assert evaluate(spark, cases, lambda p, f: R.find_all_text("t", p, f)) == [c[3] for c in FIND_ALL]
    for unit in ("char", "byte"):
        for case, got in zip(FIND_ALL, evaluate(spark, cases, lambda p, f, u=unit: R.find_all("t", p, f, offsets=u)), strict=True):
            assert [m.match for m in got] == case[3]
            raw = case[2] if unit == "char" else case[2].encode()
            assert [(raw[m.start : m.end] if unit == "char" else raw[m.start : m.end].decode()) for m in got] == case[3]
    df = spark.createDataFrame([("a1é22b",), (None,), ("x\ufdd1\ufdd0é7",), ("1\ufdd1\ufdd9",)], "t string")
    rows = df.select(R.find_all("t", r"(\d)(x)?", offsets="byte").alias("v")).collect()
    assert [(m.start, m.end, m.captures) for m in rows[0].v] == [(1, 2, ["1", ""]), (4, 5, ["2", ""]), (5, 6, ["2", ""])]
    assert rows[1].v is None and [(m.match, m.start, m.end) for m in rows[2].v] == [("7", 9, 10)]
    assert rows[3].v is None  # it holds marks of both sets
    found = df.select(R.find("t", r"(\d)$").alias("v"), R.split("t", r"\d*").alias("s")).collect()
    assert (found[2].v.start, found[2].v.captures, found[2].s[1]) == (4, ["7"], "x") and found[3].v is None


STALE = [
    (r"(z)((a+)?(b+)?(c))*", "zaacbbbcac", ["z", "ac", "a", None, "c"]),
    (r"(?:(a)|b)*", "ab", [None]),
    (r"(?:(a)|(b))*", "abab", [None, "b"]),
    (r"(?:(?:(a)|b)c)+d", "acbcd", [None]),
    (r"(?:(?:(a)|b)+;)*", "ab;b;", [None]),
    (r"(?:(?:(a)|b)+;)*", "b;ab;ba;", ["a"]),
    (r"(?:(\d)?x){2}", "1xx", [None]),
    (r"(?:(\d)?x){2}", "x2x", ["2"]),
]


def test_captures_of_earlier_rounds_are_cleared(spark):
    for pattern, text, want in STALE:
        p = compile_pattern(pattern)
        df = spark.createDataFrame([("éy" + text,)], "t string")
        r = df.select(R.captures("t", f"y(?:{pattern})").alias("c"), R.find("t", f"y(?:{pattern})", offsets="byte")["capture_spans"].alias("s"), R.capture("t", f"y(?:{pattern})", p.group_count).alias("last")).first()
        assert r.c == want and r.last == (want[-1] or ""), pattern
        assert [None if s is None else ("éy" + text).encode()[s.start : s.end].decode() for s in r.s] == want
        with pytest.raises(PatternError) as error:
            R.find_all("t", pattern)
        assert error.value.code == "NotImplemented" and "find()" in str(error.value)
        with pytest.raises(PatternError):
            R.replace_all("t", pattern, f"<${max(p.stale_groups)}>")
        R.replace_all("t", pattern, "<$0>")


def test_time_grows_with_the_matches(spark):
    import time

    from patternlake.operators import explode_matches

    def took(n, build):
        df = spark.createDataFrame([("ab " * n,)], "t string").cache()
        df.count()
        best = 1e9
        for _ in range(2):
            began = time.time()
            assert build(df) == n
            best = min(best, time.time() - began)
        return best

    def found(df):
        return df.select(F.size(R.find_all("t", r"\w+"))).first()[0]

    def rows(df):
        return explode_matches(df, "t", r"\w+").count()

    def lines(df):
        return R.matching_lines(df.select(F.replace("t", F.lit("b "), F.lit("\n")).alias("t")), "t", "a").agg(F.count("start")).first()[0]

    for build in (found, rows, lines):
        took(1000, build)
        small, large = took(16_000, build), took(64_000, build)
        assert large < 8 * small + 1, (build, small, large)  # the square would be sixteen times


REPLACE = [
    (r"(\d+)", "", "100", "$$$1", "$100", "$100"),
    (r"(\w+)", "", "test", "$1 $2", "test $2", "test $2"),
    (r"\s+", "", "This   has    spaces", " ", "This has    spaces", "This has spaces"),
    (r"(a)(b)?", "", "ab a", "[$2|$1|$0]", "[b|a|ab] a", "[b|a|ab] [|a|a]"),
    (r"(a)", "", "aa", "$10", "a0a", "a0a0"),
    (r"a", "", "banana", r"\n$", r"b\n$nana", r"b\n$n\n$n\n$"),
    (r"a", "", "xaxa", "1", "x1xa", "x1x1"),
    (r"(x)\1", "", "axxbxx", "<$1>", "a<x>bxx", "a<x>b<x>"),
    (r"z", "", "none", "y", "none", "none"),
    (r"a*", "", "baac", "X", "Xbaac", "XbXXcX"),
]


def test_replace(spark):
    for pattern, flags, text, template, first, every in REPLACE:
        df = spark.createDataFrame([(text,), (None,)], "t string")
        rows = df.select(R.replace("t", pattern, template, flags), R.replace_all("t", pattern, template, flags)).collect()
        assert tuple(rows[0]) == (first, every), (pattern, template)
        assert tuple(rows[1]) == (None, None)


def test_split(spark):
    cases = [(",", "", "John,Doe,30,Engineer", ["John", "Doe", "30", "Engineer"]), (",", "", ",a,", ["", "a", ""]), ("x", "", "", [""]), (r"\s*", "", "a b", ["", "a", "", "b", ""]), ("", "", "abc", ["", "a", "b", "c", ""])]
    assert evaluate(spark, [c[:3] for c in cases], lambda p, f: R.split("t", p, f)) == [c[3] for c in cases]


def test_captures(spark):
    p = r"(?P<year>\d{4})-(?<month>\d\d)(?:-(?<day>\d\d))?"
    df = spark.createDataFrame([(1, "on 2024-05-17."), (2, "in 2024-05"), (3, "never"), (4, None)], "k long, t string").orderBy("k")
    rows = df.select(R.capture("t", p, "month").alias("m"), R.capture("t", p, 3).alias("d"), R.captures("t", p).alias("c"), R.named_captures("t", p).alias("n")).collect()
    assert [(r.m, r.d) for r in rows] == [("05", "17"), ("05", ""), (None, None), (None, None)]
    assert rows[1].c == ["2024", "05", None] and rows[0].n == {"year": "2024", "month": "05", "day": "17"} and rows[1].n["day"] is None and rows[2].n is None
    c = compile_pattern(p)
    assert (c.capture_index("month"), c.capture_index("none")) == (2, None)
    with pytest.raises(ValueError):
        R.capture("t", p, "none")
    both = r"(?:(?<x>a)1|(?<x>b)2)"
    assert compile_pattern(both).capture_indexes("x") == (1, 2)
    assert [r[0] for r in spark.createDataFrame([("b2",), ("a1",)], "t string").select(R.capture("t", both, "x")).collect()] == ["b", "a"]


LINES = "a@b\nno at here\nx@y z\n@bad\ngood@\n"


def test_lines(spark):
    df = spark.createDataFrame([(1, LINES), (2, ""), (3, None), (4, "é@x\na@b")], "id long, t string").orderBy("id")
    assert [r[0] for r in df.select(R.count_matching_lines("t", r"\w+@\w+")).collect()] == [2, 0, None, 1]
    assert [r[0] for r in df.select(R.count_matching_lines("t", "^$")).collect()] == [1, 1, None, 0]
    rows = R.matching_lines(df, "t", r"\w+@\w+").orderBy("id", "line_no").collect()
    assert [(r.id, r.line_no, r.start, r.end, r.line) for r in rows] == [(1, 0, 0, 3, "a@b"), (1, 2, 15, 20, "x@y z"), (4, 1, 5, 8, "a@b")]
    for r in rows[:2]:
        assert LINES.encode()[r.start : r.end].decode() == r.line


PROPERTIES = [
    (r"^\p{Emoji}$", "u", "\U0001f600", True), (r"^\p{Emoji}$", "u", "x", False), (r"^\p{ExtPict}$", "u", "\u2764", True), (r"^\p{Math}\p{Dash}\p{QMark}$", "u", "+\u2014\u201c", True),
    (r"^\p{Diacritic}$", "u", "^", True), (r"^\p{Changes_When_NFKC_Casefolded}$", "u", "A", True), (r"^\p{IDC}+$", "u", "a_1", True), (r"^[\p{Sentence_Terminal}--[!]]$", "v", "!", False),
    (r"^\p{scx=Deva}$", "u", "\u0964", True), (r"^\p{sc=Deva}$", "u", "\u0964", False), (r"^\p{Devanagari}$", "u", "\u0964", True), (r"^\P{Script_Extensions=Greek}$", "u", "\u03b1", False),
    (r"^\p{RGI_Emoji}$", "v", "\U0001f468\u200d\U0001f469\u200d\U0001f467", True), (r"^\p{RGI_Emoji}$", "v", "\U0001f468\u200d\U0001f469x", False), (r"^\p{RGI_Emoji_Flag_Sequence}{2}$", "v", "\U0001f1e9\U0001f1ea\U0001f1eb\U0001f1f7", True),
    (r"^[\p{Emoji_Keycap_Sequence}a]+$", "v", "1\ufe0f\u20e3a", True), (r"^\p{Emoji_Keycap_Sequence}$", "v", "1", False), (r"^\p{RGI_Emoji_Modifier_Sequence}$", "v", "\U0001f44d\U0001f3fd", True), (r"^\p{Basic_Emoji}$", "v", "\U0001f600", True),
]


def test_properties(spark):
    got = evaluate(spark, [c[:3] for c in PROPERTIES], lambda p, f: R.is_match("t", p, f))
    assert [c for c, g in zip(PROPERTIES, got, strict=True) if g != c[3]] == []
    for name in BINARY:
        compile_pattern(f"\\p{{{name}}}", "u")
    for pattern, flags in ((r"\p{Nope}", ""), (r"\p{sc=Nope}", "u"), (r"\p{emoji}", "u"), (r"\P{RGI_Emoji}", "v"), (r"\p{RGI_Emoji}", "u"), (r"[^\p{RGI_Emoji}]", "v")):
        with pytest.raises(PatternError):
            compile_pattern(pattern, flags)
    assert compile_pattern(r"\p{emoji}").java == compile_pattern(r"\p{Emoji}").java


def test_columns_of_any_name(spark):
    from patternlake.operators import explode_matches, match_counts

    names = ["_found", "_m", "m", "found", "row", "match", "line", "_lines", "_starts", "start", "a.b c"]
    df = spark.createDataFrame([("a1\nb\na2",)], "t string").selectExpr("t", *[f"'{k}' AS `{c}`" for k, c in enumerate(names)])
    rows = explode_matches(df, "t", r"a(\d)")
    assert rows.columns == ["_found", "_m", "m", "found", "row", "match_", "line", "_lines", "_starts", "start_", "a.b c", "ordinal", "match", "start", "end", "captures"]
    assert [tuple(r) for r in rows.collect()] == [(*map(str, range(11)), 0, "a1", 0, 2, ["1"]), (*map(str, range(11)), 1, "a2", 5, 7, ["2"])]
    lines = R.matching_lines(df, "t", r"\d")
    assert lines.columns[-4:] == ["line_no", "start", "end", "line"] and "line_" in lines.columns and [(r.line_no, r.start, r.line_) for r in lines.collect()] == [(0, 0, "6"), (2, 5, "6")]
    assert [tuple(r) for r in match_counts(df, "t", "a", ["a.b c", "line"]).collect()] == [("10", "6", 1, 1, 2)]


def test_word_boundaries_beside_anything(spark):
    cases = [(p, "", t) for p in (r"\bab\b", r"\b[a-c]+\b!", r"\b-x\b", r"(?:a|-)\b", r"\b\w+\b", r"x\b\b-", r"\b(?:ab)?-\b", r"[a-\u00e9]\b") for t in ("ab", "xab", "ab-x", "-x", "a-b", "\u00e9ab!", "abc! ab-", "x-", "")]
    word = "[A-Za-z0-9_]"
    plain = f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"
    import re

    for (p, _, t), n in zip(cases, evaluate(spark, cases, lambda p, f: R.count("t", p, f)), strict=True):
        assert n == len(re.findall(p.replace(r"\b", plain).replace(r"\w", word), t)), (p, t)


ERRORS = {
    "?abc": "UnexpectedCharacter", "a**": "InvalidQuantifier", "a+*": "InvalidQuantifier", "(abc": "UnmatchedParenthesis", "abc)": "UnmatchedParenthesis", "[abc": "UnmatchedBracket", "*": "UnexpectedCharacter", "+abc": "UnexpectedCharacter",
    "\\": "UnexpectedEndOfPattern", "[z-a]": "InvalidCharacterClass", "a{5,3}": "InvalidQuantifier", "a{1,99999999999999999}": "InvalidQuantifier", "(?>a)": "UnexpectedCharacter", "a++": "InvalidQuantifier", "[[:foo:]]": "InvalidCharacterClass",
    "(?<a>x)(?<a>y)": "DuplicateGroupName", "(?<a>x)\\k<b>": "InvalidBackreference", "(?ii:a)": "UnexpectedCharacter", "(?<=a)*": "InvalidQuantifier", "(a+)+": "PatternTooComplex", "(a*)*": "PatternTooComplex", "(" * 600 + ")" * 600: "NestingTooDeep",
    "\\p{Nope!}": "InvalidEscapeSequence",
}


@pytest.mark.parametrize("pattern", ERRORS)
def test_errors_on_the_driver(pattern):
    with pytest.raises(PatternError) as error:
        compile_pattern(pattern)
    assert error.value.code == ERRORS[pattern] and error.value.hint


def test_unicode_mode_is_strict():
    for pattern, code in ((r"\h", "InvalidEscapeSequence"), ("a{", "InvalidQuantifier"), (r"\1", "InvalidBackreference"), ("]", "UnexpectedCharacter"), (r"[\d-x]", "InvalidCharacterClass"), (r"(?=a)*", "InvalidQuantifier")):
        compile_pattern(pattern)
        with pytest.raises(PatternError) as error:
            compile_pattern(pattern, "u")
        assert error.value.code == code


def test_safe_repeats_compile():
    for pattern in (r"(?:\d+)+", r"(?:/\w+)*", r"(?:https?://)?", r"(?:[A-Za-z_]|-)+", r"(?:a+b)+", r"(\w+\s)*", r"(?:x|y)*"):
        assert not compile_pattern(pattern).risk.above("high")


def test_facts():
    c = compile_pattern(r"ab(?:c|de)?x+")
    assert (c.min_length, c.max_length, c.required_literal, c.literal_prefix, c.can_match_empty, c.is_finite) == (3, None, "ab", "ab", False, False)
    assert compile_pattern("^abc$").exact_literal == ("abc", True, True) and compile_pattern("cat|dog").literal_set == ("cat", "dog")
    assert compile_pattern("(?i)abc").required_literal == "" and compile_pattern(r"(?:(a)|b)*").captures_sticky and not compile_pattern("(a)+").captures_sticky
    assert compile_pattern("a") is compile_pattern("a")


def test_literal_facts_reach_the_scan(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = lambda p: df.filter(R.is_match("text", p))._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(text,license)" in plan("license") and "regexp" not in plan("license").lower()
    assert "StringContains(text,@)" in plan(r"\w+@\w+") and "StringStartsWith(text,The )" in plan("^The ") and "StringEndsWith(text,end)" in plan("end$")
    assert df.filter(R.is_match("text", r"\w+@\w+")).count() == df.filter(F.regexp_like("text", F.lit(compile_pattern(r"\w+@\w+").java))).count()
