"""The registered queries of the pattern engine and their SQL equivalents.

SQL runs RE2 patterns.  Where RE2 has no equivalent (look-around, references), the SQL counts
in another way.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from patternlake import functions as R
from patternlake.authoring import PATTERNS, Builder, Composer, Macros, escape
from patternlake.authoring.library import extract_all, validates
from patternlake.authoring.lint import complexity_columns, lint_report
from patternlake.authoring.macros import COMMON
from patternlake.authoring.printers import s_expression, statistics
from patternlake.dialect import compile_pattern
from patternlake.functions import sql as S
from patternlake.functions import unicode as U
from patternlake.operators import explode_matches, match_counts, pattern_anti_join, pattern_join, pattern_semi_join, pattern_table_join, top_matches
from patternlake.plans.lineage import ensure_checkpoint_dir
from patternlake.sources import grep, grep_counts, read_tree
from patternlake.streaming import windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: Queries whose tasks import this package.
IN_PYTHON = {"pattern_table"}

#: White space of the dialect in RE2.
_S = r"[\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_PHONE = PATTERNS["phoneUS"]


def _re2(pattern: str) -> str:
    """A library pattern in RE2: only its white space differs."""
    return pattern.replace(r"[-.\s]", "[-." + _S[1:]).replace("'", "''")


def _table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _add(name: str, query: Query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle is not None:
        ORACLE_SQL[name] = oracle


def phones_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """US phone numbers: documents with one, and all of them, per language."""
    return match_counts(_table("documents")(spark, sf_dir), "text", _PHONE, ["lang"])


def _counts(name: str, pattern: str, flags: str = "", re2: str = "", *, n: str = "", table: str = "documents", text: str = "text", by: str = "lang") -> None:
    """Register counts per group; ``re2`` is '' where the pattern is RE2 as it stands; ``n`` counts a text's matches where RE2 can't."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _table(table)(spark, sf_dir).select(F.col(by), F.expr(text).alias("t"))
        return match_counts(rows, "t", pattern, [by], flags)

    p = (re2 or pattern).replace("'", "''")
    n = n or f"len(regexp_extract_all({text}, '{p}'))"
    _add(name, query, f"SELECT {by}, count(*) AS texts, count(*) FILTER (n > 0) AS texts_with_match, coalesce(sum(n), 0)::BIGINT AS matches FROM (SELECT {by}, {n} AS n FROM {table}) GROUP BY {by}")


# ---------------------------------------------------------------- verbs

_add("phones_by_language", phones_by_language, f"SELECT lang, count(*) AS texts, count(*) FILTER (regexp_matches(text, '{_re2(_PHONE)}')) AS texts_with_match, sum(len(regexp_extract_all(text, '{_re2(_PHONE)}')))::BIGINT AS matches FROM documents GROUP BY lang")


def _project(name: str, table: str, key: str, columns: Callable[[], dict[str, Column]], oracle: str | None, where: Callable[[], Column] | None = None) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _table(table)(spark, sf_dir)
        rows = rows if where is None else rows.filter(where())
        return rows.select(F.col(key), *[c.alias(n) for n, c in columns().items()])

    _add(name, query, oracle)


_project("is_match", "documents", "doc_id", lambda: {"hit": R.is_match("text", r"[a-z]+@[a-z]+\.com")}, "SELECT doc_id, regexp_matches(text, '[a-z]+@[a-z]+\\.com') AS hit FROM documents")
_project("is_match_literal", "documents", "doc_id", lambda: {"lang": F.col("lang")}, "SELECT doc_id, lang FROM documents WHERE contains(text, 'license')", lambda: R.is_match("text", "license"))
_project("find_text", "documents", "doc_id", lambda: {"found": R.find_text("text", r"[A-Z][a-z]+, [a-z]+")}, "SELECT doc_id, CASE WHEN regexp_matches(text, '[A-Z][a-z]+, [a-z]+') THEN regexp_extract(text, '[A-Z][a-z]+, [a-z]+') END AS found FROM documents")
def _found_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields of one search: the struct is named first, so it is computed once."""
    found = _table("pages")(spark, sf_dir).select("page_id", R.find("url", r"/([a-z]{2})/(\d+)").alias("f"))
    return found.select("page_id", "f.match", "f.start", "f.end", F.col("f.captures")[0].alias("lang"), F.col("f.capture_spans")[0]["start"].alias("lang_start"))


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _table("orders")(spark, sf_dir).select("o_orderkey", R.named_captures(F.col("o_orderdate").cast("string"), r"(?<year>\d{4})-(?P<month>\d\d)-(?<day>\d\d)").alias("c"))
    return found.select("o_orderkey", *[F.col("c")[k].alias(k) for k in ("year", "month", "day")])


_add("find_struct", _found_struct,
         r"SELECT page_id, m AS match, s AS start, s + length(m) AS end, regexp_extract(m, '/([a-z]{2})', 1) AS lang, s + 1 AS lang_start FROM (SELECT page_id, nullif(regexp_extract(url, '/[a-z]{2}/\d+'), '') AS m, length(regexp_extract(url, '^(.*?)/[a-z]{2}/\d+', 1))::INTEGER AS s FROM pages)")
_project("find_from", "documents", "doc_id", lambda: {"found": R.find_from("text", "[a-z]{5}", 40)["match"]}, "SELECT doc_id, CASE WHEN regexp_matches(text, '(?s)\\A.{40}.*?([a-z]{5})') THEN regexp_extract(text, '(?s)\\A.{40}.*?([a-z]{5})', 1) END AS found FROM documents")
_add("find_all_rows", lambda spark, sf_dir: explode_matches(_table("pages")(spark, sf_dir).select("page_id", "url"), "url", r"[a-z]+\.(?:com|org|net)|\d+").drop("captures"),
     r"""WITH f AS (SELECT page_id, regexp_extract_all(url, '[a-z]+\.(?:com|org|net)|\d+') AS m, regexp_split_to_array(url, '[a-z]+\.(?:com|org|net)|\d+') AS g FROM pages),
k AS (SELECT *, unnest(range(len(m)))::INTEGER AS ordinal FROM f),
p AS (SELECT page_id, ordinal, m[ordinal + 1] AS match, (coalesce(list_sum(list_transform(g[1:ordinal + 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:ordinal], lambda x: length(x))), 0))::INTEGER AS start FROM k)
SELECT page_id, ordinal, match, start, (start + length(match))::INTEGER AS end FROM p""")  # fmt: skip
_add("iterate", lambda spark, sf_dir: _table("events")(spark, sf_dir).select("event_id", F.posexplode(R.find_all_text("props", r"\w+")).alias("ordinal", "match")),
     r"SELECT event_id, (unnest(range(len(m))))::INTEGER AS ordinal, unnest(m) AS match FROM (SELECT event_id, regexp_extract_all(props, '\w+') AS m FROM events)")
_project("count", "documents", "doc_id", lambda: {"n": R.count("text", r"\w+")}, r"SELECT doc_id, len(regexp_extract_all(text, '\w+'))::BIGINT AS n FROM documents")
_project("count_prefiltered", "documents", "doc_id", lambda: {"n": R.count("text", r"\w+tion\b")}, r"SELECT doc_id, len(regexp_extract_all(text, '\w+tion\b'))::BIGINT AS n FROM documents")
_project("count_matching_lines", "documents", "doc_id", lambda: {"n": R.count_matching_lines("text", r"^The\b")}, r"SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^The\b')))::BIGINT AS n FROM documents")
_add("count_lines_total", lambda spark, sf_dir: _table("documents")(spark, sf_dir).agg(F.sum(R.count_matching_lines("text", r"[0-9]")).alias("n")), "SELECT sum(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[0-9]'))))::BIGINT AS n FROM documents")
_add("matching_lines", lambda spark, sf_dir: R.matching_lines(_table("documents")(spark, sf_dir).select("doc_id", "text"), "text", r"@|\d{3}-\d{4}"),
     r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents), k AS (SELECT *, unnest(range(len(x)))::INTEGER AS line_no FROM l),
p AS (SELECT doc_id, line_no, x[line_no + 1] AS line, (coalesce(list_sum(list_transform(x[1:line_no], lambda y: strlen(y) + 1)), 0))::INTEGER AS start FROM k)
SELECT doc_id, line_no, line, start, (start + strlen(line))::INTEGER AS end FROM p WHERE regexp_matches(line, '@|\d{3}-\d{4}')""")  # fmt: skip
_project("replace", "pages", "page_id", lambda: {"out": R.replace("url", r"([a-z]+)\.example\.(com|org)", "$2:$1")}, r"SELECT page_id, regexp_replace(url, '([a-z]+)\.example\.(com|org)', '\2:\1') AS out FROM pages")
_project("replace_all", "documents", "doc_id", lambda: {"out": F.md5(R.replace_all("text", r"(\w)(\w+)", "$2$1$$"))}, r"SELECT doc_id, md5(regexp_replace(text, '(\w)(\w+)', '\2\1$', 'g')) AS out FROM documents")
_project("split", "pages", "page_id", lambda: {"n": F.size(R.split("url", r"[/?#]")), "last": F.element_at(R.split("url", r"[/?#]"), -1)}, "SELECT page_id, len(p)::INTEGER AS n, p[-1] AS last FROM (SELECT page_id, regexp_split_to_array(url, '[/?#]') AS p FROM pages)")
_project("captures", "pages", "page_id", lambda: {"host": R.capture("url", r"://([^/]+)/(\w+)", 1), "section": R.capture("url", r"://([^/]+)/(\w+)", 2)}, r"SELECT page_id, regexp_extract(url, '://([^/]+)/(\w+)', 1) AS host, regexp_extract(url, '://([^/]+)/(\w+)', 2) AS section FROM pages")
_add("named_captures", _named,
         r"SELECT o_orderkey, c.year AS year, c.month AS month, c.day AS day FROM (SELECT o_orderkey, regexp_extract(o_orderdate::VARCHAR, '(?P<year>\d{4})-(?P<month>\d\d)-(?P<day>\d\d)', ['year', 'month', 'day']) AS c FROM orders)")

# ---------------------------------------------------------------- constructs

_counts("construct_literal", "tion")
_counts("construct_unicode_literal", "é")
_counts("construct_dot", "th.s", re2=r"th[^\n\r\x{2028}\x{2029}\x{10000}-\x{10FFFF}]s")
_counts("construct_concat", "the of")
_counts("construct_alternation", "and|the|of")
_counts("construct_alternation_empty", "x(?:y|)z?")
_counts("construct_star", "ab*l")
_counts("construct_plus_lazy", "e+?[rn]")
_counts("construct_optional", "colou?r|th?e")
_counts("construct_bounds", r"[a-z]{3,5}\b")
_counts("construct_bounds_lazy", "[a-z]{2,4}?t")
_counts("construct_swap_greedy", r"(?U:[a-z]+)t", re2="[a-z]+?t")
_counts("construct_class", "[aeiou][^aeiou\\s]", re2="[aeiou][^aeiou" + _S[1:])
_counts("construct_digit_word", r"\d\w\D", re2=r"\d\w[^0-9]")
_counts("construct_space", r"\s\S+\s", re2=_S + "[^" + _S[1:] + "+" + _S)
_counts("construct_posix", "[[:upper:]][[:lower:]]+[[:punct:]]")
_counts("construct_class_sets", "[[a-z]--[aeiou]]{2}", "v", re2="[b-df-hj-np-tv-z]{2}")
_counts("construct_class_intersection", "[\\w&&[^0-9_]]{4}", "v", re2="[a-zA-Z]{4}")
_counts("construct_class_strings", r"[\q{tion|ing|z}x]", "v", re2="(?:tion|ing|[xz])")
_counts("construct_property", r"\p{Lu}\p{Ll}+", "u")
_counts("construct_property_script", r"\p{Script=Latin}+", "u", re2=r"\p{Latin}+")
_counts("construct_property_binary", r"\p{ASCII}{3}", "u", re2=r"[\x{0}-\x{7F}]{3}")
_counts("construct_groups", "(th)(e|is)", re2="(?:th)(?:e|is)")
_counts("construct_noncapturing", "(?:re)+a")
_counts("construct_named_group", "(?<head>[A-Z])(?P<tail>[a-z]+)", re2="[A-Z][a-z]+")
_counts("construct_lookahead", "th(?=e)", re2="the")
_counts("construct_negative_lookahead", "th(?!e)", n="len(regexp_extract_all(text, 'th')) - len(regexp_extract_all(text, 'the'))")
_counts("construct_lookbehind", "(?<=th)e", re2="the")
_counts("construct_negative_lookbehind", "(?<!th)e", n="len(regexp_extract_all(text, 'e')) - len(regexp_extract_all(text, 'the'))")
_counts("construct_backreference", r"\b(\w+) \1\b")
# Runs of k equal words, one space apart, hold k div 2 matches.
ORACLE_SQL["construct_backreference"] = r"""
WITH t AS (SELECT row_number() OVER () AS rn, lang, text FROM documents),
w AS (SELECT rn, unnest(e) AS w, generate_subscripts(e, 1) AS i FROM (SELECT rn, regexp_extract_all(text, '\w+|\W+') AS e FROM t)),
p AS (SELECT rn, i // 2 AS k FROM (SELECT *, lead(w, 1) OVER o AS gap, lead(w, 2) OVER o AS other FROM w WINDOW o AS (PARTITION BY rn ORDER BY i)) WHERE gap = ' ' AND other = w),
r AS (SELECT rn, count(*) AS pairs FROM (SELECT rn, k, k - row_number() OVER (PARTITION BY rn ORDER BY k) AS run FROM p) GROUP BY rn, run),
n AS (SELECT rn, sum((pairs + 1) // 2) AS n FROM r GROUP BY rn)
SELECT lang, count(*) AS texts, count(*) FILTER (n > 0) AS texts_with_match, coalesce(sum(n), 0)::BIGINT AS matches FROM t LEFT JOIN n ON t.rn = n.rn GROUP BY lang"""
_counts("construct_property_dash", r"\p{Dash}|\p{Quotation_Mark}", "u", re2=r"""[\-\x{58a}\x{5be}\x{1400}\x{1806}\x{2010}-\x{2015}\x{2053}\x{207b}\x{208b}\x{2212}\x{2e17}\x{2e1a}\x{2e3a}\x{2e3b}\x{2e40}\x{2e5d}\x{301c}\x{3030}\x{30a0}\x{fe31}\x{fe32}\x{fe58}\x{fe63}\x{ff0d}\x{10d6e}\x{10ead}"'\x{ab}\x{bb}\x{2018}-\x{201f}\x{2039}\x{203a}\x{2e42}\x{300c}-\x{300f}\x{301d}-\x{301f}\x{fe41}-\x{fe44}\x{ff02}\x{ff07}\x{ff62}\x{ff63}]""")
_counts("construct_script_extensions", r"\p{scx=Cyrillic}|\p{Script_Extensions=Latin}{5}", "u", re2=r"[A-Za-z\x{aa}\x{b7}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{2b8}]{5}|[\x{400}-\x{52f}]")
_counts("construct_property_of_strings", r"[\p{Emoji_Keycap_Sequence}\p{Emoji_Modifier}e]", "v", re2=r"[0-9#*]\x{fe0f}\x{20e3}|[\x{1f3fb}-\x{1f3ff}e]")
_counts("construct_named_backreference", r"(?<c>[a-z])\k<c>", re2="aa|bb|cc|dd|ee|ff|gg|hh|ii|jj|kk|ll|mm|nn|oo|pp|qq|rr|ss|tt|uu|vv|ww|xx|yy|zz")
_counts("construct_anchors", "^[A-Z]|[.]$", re2=r"\A[A-Z]|[.]\z")
_counts("construct_anchors_multiline", "^[A-Z]\\w*", "m", re2="(?m)^[A-Z]\\w*")
_counts("construct_text_anchors", r"\A\w+|\w+[.]\z")
_counts("construct_word_boundary", r"\b[a-z]+\b")
_counts("construct_not_word_boundary", r"\Bt\B")
_counts("construct_inline_flags", "(?i:the) (?-i:a)|(?i)OF", re2="(?i:the) a|(?i:of)")
_counts("construct_ignore_case", "the", "i", re2="(?i)the")
_counts("construct_extended", "t h  # comment\n e", "x", re2="the")
_counts("construct_dot_all", "[.].[A-Z]", "s", re2="(?s)[.].[A-Z]")
_counts("construct_escapes", r"\x2e\u000a\x41?", re2=r"\x2e\n\x41?")
_counts("construct_braced_escape", r"\u{e9}\w", "u", re2=r"\x{e9}\w")
_counts("construct_identity_escape", r"t\h\e", re2="the")

_counts("escaped_literal", escape("s. "), re2=r"s\. ")
_counts("flags_combined", "^ [t] he [ ] \\w+  # a line's first words", "imx", re2=r"(?im)^the \w+")

# ---------------------------------------------------------------- throughput

#: Patterns of published text-scan figures (fixed values).
THROUGHPUT = {
    "literal": "hello",
    "literals": "hello|world|test",
    "digits": r"\d+",
    "words": r"\w+",
    "letters": "[A-Za-z]+",
    "digits_bounded": r"\d{1,3}",
    "prefix": "foo[0-9]+",
    "words_digit": r"\w+[0-9]",
    "captures": "([a-z]+)([0-9]+)",
    "dot": "a.c",
    "ignore_case": "(?i)hello",
}
_THROUGHPUT_RE2 = {"captures": "[a-z]+[0-9]+", "dot": r"a[^\n\r\x{2028}\x{2029}\x{10000}-\x{10FFFF}]c"}
for _name, _pattern in THROUGHPUT.items():
    _counts(f"throughput_{_name}", _pattern, re2=_THROUGHPUT_RE2.get(_name, ""))

# ---------------------------------------------------------------- authoring

_LIBRARY = {
    "email": ("documents", "text", "lang"), "url": ("pages", "url", None), "ipv4": ("documents", "text", "lang"), "phoneUS": ("documents", "text", "lang"), "dateISO": ("orders", "cast(o_orderdate AS string)", "o_orderstatus"),
    "time24": ("events", "cast(ts AS string)", "event_type"), "hexColor": ("documents", "text", "lang"), "creditCard": ("documents", "text", "lang"), "uuid": ("documents", "text", "lang"),
    "integer": ("events", "props", "event_type"), "decimal": ("documents", "text", "lang"), "identifier": ("documents", "text", "lang"),
}
for _name, (_from, _text, _by) in _LIBRARY.items():
    if _by is not None:
        _counts(f"library_{_name}", PATTERNS[_name], re2=_re2(PATTERNS[_name]).replace("''", "'"), table=_from, text=_text, by=_by)
_project("library_url", "pages", "page_id", lambda: {"found": F.array_join(extract_all("url", "url"), " "), "whole": validates("url", "url")},
         f"SELECT page_id, array_to_string(regexp_extract_all(url, '{_re2(PATTERNS['url'])}'), ' ') AS found, regexp_full_match(url, '{_re2(PATTERNS['url'])}') AS whole FROM pages")
_project("library_validate", "customer", "c_custkey", lambda: {"identifier": validates("identifier", "c_name"), "integer": validates("integer", F.col("c_custkey").cast("string"))},
         "SELECT c_custkey, regexp_full_match(c_name, '[a-zA-Z_][a-zA-Z0-9_]*') AS identifier, regexp_full_match(c_custkey::VARCHAR, '[0-9]+') AS integer FROM customer")
_counts("builder", Builder().word_boundary().char_range("A", "Z").start_non_capturing_group().char_class("a-z").one_or_more().end_group().repeat_range(1, 2).literal(".").build(), re2=r"\b[A-Z](?:[a-z]+){1,2}\.")
_counts("composer", Composer().add("the [a-z]+").add("of [a-z]+").alternatives(), re2="the [a-z]+|of [a-z]+")
_counts("macros", Macros(COMMON).expand("${upper}${lower}+[.]"), re2="[A-Z][a-z]+[.]")
_project("lint_complexity", "pages", "page_id", lambda: complexity_columns(F.col("html")),
         r"""WITH c AS (SELECT page_id, html, unnest(range(1, length(p) + 1)) AS i, p FROM (SELECT page_id, html, regexp_replace(html, '[^()]', '', 'g') AS p FROM pages)),
r AS (SELECT page_id, i, sum(CASE WHEN p[i] = '(' THEN 1 ELSE -1 END) OVER (PARTITION BY page_id ORDER BY i) AS s FROM c),
d AS (SELECT page_id, max(s - least(0, low)) AS depth FROM (SELECT *, min(s) OVER (PARTITION BY page_id ORDER BY i) AS low FROM r) GROUP BY page_id),
n AS (SELECT p.page_id, strlen(html) AS length, greatest(coalesce(depth, 0), 0)::BIGINT AS nesting, len(regexp_extract_all(html, '\(')) AS groups, len(regexp_extract_all(html, '[+*?]')) AS quantifiers, len(regexp_extract_all(html, '\|')) AS alternations, len(regexp_extract_all(html, '\[')) AS classes FROM pages p LEFT JOIN d ON p.page_id = d.page_id),
s AS (SELECT *, length // 10 + 5 * nesting + 2 * groups + quantifiers + 2 * alternations + classes AS score FROM n)
SELECT *, CASE WHEN score < 10 THEN 'low' WHEN score < 25 THEN 'medium' WHEN score < 50 THEN 'high' ELSE 'very_high' END AS level FROM s""")  # fmt: skip


_LINTED = [*PATTERNS.values(), "(a+)+", "a**", "(|x)", "^(p|q|r)$"]


def _lint_sql() -> str:
    """The lint rules that the query's patterns meet, place by place."""
    quoted = ", ".join("('" + p.replace("'", "''") + "')" for p in _LINTED)
    here = "substr(pattern, i)"
    rules = [
        (rf"regexp_matches({here}, '^(?s:\(.[+*]\)[+*])')", "error", "catastrophic_backtracking", "i - 1", "nested quantifiers can take exponential time", "let iterations begin with a fixed character"),
        (f"{here}[1] = '|'", "info", "ambiguous_pattern", "i - 1", "branches that overlap are tried in turn", None),
        (f"{here}[1] = '|' AND (i = 1 OR pattern[i - 1] IN ('(', '|') OR pattern[i + 1] IN ('', ')', '|'))", "warning", "empty_alternation", "i - 1", "an empty branch", "make the group optional"),
        (f"regexp_matches({here}, '^[+*?][+*?]')", "warning", "redundant_quantifier", "i - 1", "a quantifier after another", "keep one"),
        (rf"regexp_matches({here}, '^\((\?:)?([^\\()|\[\]]\|)+[^\\()|\[\]]\)')", "info", "optimization_opportunity", "i - 1", "single characters as branches", "[]"),
        (f"strpos(pattern, '.*') = i", "info", "optimization_opportunity", "i - 1", "an open wildcard", "use a narrower class or an anchor"),
        ("i = 1 AND regexp_matches(pattern, '^[0-9A-Za-z].')", "info", "optimization_opportunity", "0", "an anchor would limit the search to the start", None),
    ]
    single = rf"'use [' || replace(regexp_extract({here}, '^\((?:\?:)?((?:[^\\()|\[\]]\|)+[^\\()|\[\]])\)', 1), '|', '') || ']'"
    parts = [f"SELECT pattern, '{level}' AS level, '{kind}' AS type, ({at})::INTEGER AS position, '{said}' AS message, {'NULL' if advice is None else single if advice == '[]' else repr(advice)} AS suggestion FROM places WHERE {where}" for where, level, kind, at, said, advice in rules]
    return f"WITH patterns(pattern) AS (VALUES {quoted}), places AS (SELECT pattern, unnest(range(1, length(pattern) + 1)) AS i FROM patterns)\n" + "\nUNION ALL ".join(parts)


#: Facts of the library's patterns, worked out by hand.
_FACTS = """
SELECT * FROM (VALUES ('email', 6, NULL, FALSE, 0, '@', 'safe'), ('url', 8, NULL, FALSE, 0, 'http', 'safe'), ('ipv4', 7, 15, FALSE, 0, '.', 'safe'), ('phoneUS', 10, 14, FALSE, 0, '', 'safe'),
('dateISO', 10, 10, FALSE, 0, '-', 'safe'), ('time24', 5, 8, FALSE, 0, ':', 'safe'), ('hexColor', 4, 7, FALSE, 0, '#', 'safe'), ('creditCard', 16, 19, FALSE, 0, '', 'safe'), ('uuid', 36, 36, FALSE, 0, '-', 'safe'),
('integer', 1, NULL, FALSE, 0, '', 'safe'), ('decimal', 1, NULL, FALSE, 0, '', 'safe'), ('identifier', 1, NULL, FALSE, 0, '', 'safe')) v(name, min_length, max_length, can_match_empty, groups, required_literal, risk)"""


def _categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category, script, and whether letter or digit, of every character that the documents hold."""
    chars = _table("documents")(spark, sf_dir).select(F.explode(R.find_all_text("text", "[^]")).alias("char")).distinct().filter("char >= ' '")
    return chars.select("char", U.general_category("char").alias("category"), U.script("char").alias("script"), U.is_letter("char").alias("letter"), U.is_digit("char").alias("digit"))


_SCRIPTS_SQL = " ".join(f"WHEN regexp_matches(c, '^\\p{{{name}}}$') THEN '{name}'" for name in ("Latin", "Common", "Inherited", "Greek", "Cyrillic", "Han", "Arabic", "Hebrew", "Hiragana", "Katakana", "Hangul", "Thai", "Devanagari"))
_CATEGORIES_SQL = " ".join(f"WHEN regexp_matches(c, '^\\p{{{name}}}$') THEN '{name}'" for name in U.SHORT if name != "Cn")
_add("lint_report", lambda spark, sf_dir: lint_report(spark, _LINTED), _lint_sql())
_add("unicode_categories", _categories, rf"""SELECT c AS char, CASE {_CATEGORIES_SQL} ELSE 'Cn' END AS category, CASE {_SCRIPTS_SQL} END AS script, regexp_matches(c, '^\p{{L}}$') AS letter, regexp_matches(c, '^\p{{Nd}}$') AS digit FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '(?s).')) AS c FROM documents) WHERE c >= ' '""")
_add("pattern_facts", lambda spark, sf_dir: spark.createDataFrame([(n, c.min_length, c.max_length, c.can_match_empty, c.group_count, c.required_literal, c.risk.level) for n, c in ((n, compile_pattern(p)) for n, p in PATTERNS.items())], "name string, min_length int, max_length int, can_match_empty boolean, groups int, required_literal string, risk string"), _FACTS)



def _statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of constructs, group numbers by name and complexity of a few patterns."""
    compiled = {name: compile_pattern(p) for name, p in (("date", r"(?<y>\d{4})-(?<m>\d\d)"), ("choice", "^(?:a|bc)+$"), ("quoted", "(['\"])(.*?)\\1"))}
    rows = [(n, (s := statistics(c))["groups"], s["quantifiers"], s["anchors"], c.group_count, c.capture_index("m"), c.describe()["complexity"], s_expression(c).count("(")) for n, c in compiled.items()]
    return spark.createDataFrame(rows, "name string, groups int, quantifiers int, anchors int, captures int, index_of_m int, complexity int, nodes_in_print int")


_add("pattern_statistics", _statistics, """SELECT * FROM (VALUES ('date', 2, 1, 0, 2, 2, 13, 9), ('choice', 1, 1, 2, 0, NULL, 14, 10), ('quoted', 2, 1, 0, 2, NULL, 10, 7))
v(name, groups, quantifiers, anchors, captures, index_of_m, complexity, nodes_in_print)""")  # worked out by hand
_project("json_field", "events", "event_id", lambda: {"k": R.find_text(F.get_json_object("props", "$.k"), r"[1-9]\d*$"), "sevens": R.count(F.get_json_object("props", "$.k"), "7")},
         "SELECT event_id, nullif(regexp_extract(k, '[1-9][0-9]*$'), '') AS k, len(regexp_extract_all(k, '7'))::BIGINT AS sevens FROM (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)")

# ---------------------------------------------------------------- sources, joins, SQL, windows


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table("pages")(spark, sf_dir).select(F.col("url").alias("path"), F.col("html").alias("text"))


_add("grep", lambda spark, sf_dir: grep(_files(spark, sf_dir), r"<h\d>|href="),
     r"SELECT path, line_no, line FROM (SELECT url AS path, unnest(range(1, len(l) + 1))::INTEGER AS line_no, unnest(l) AS line FROM (SELECT url, string_split(html, chr(10)) AS l FROM pages)) WHERE regexp_matches(line, '<h\d>|href=')")
_add("grep_counts", lambda spark, sf_dir: grep_counts(_files(spark, sf_dir), r"<p>", "i"), "SELECT url AS path, len(list_filter(string_split(html, chr(10)), lambda x: regexp_matches(x, '(?i)<p>')))::BIGINT AS n FROM pages")
_JOINED = {"email": PATTERNS["email"], "phone": r"\d{3}-\d{4}", "license": "license", "ing": r"\b[a-z]+ing\b"}
_JOIN_RE2 = {n: p.replace("'", "''") for n, p in _JOINED.items()}
_any = " OR ".join(f"regexp_matches(text, '{p}')" for n, p in _JOIN_RE2.items() if n != "ing")
_rare = {n: p for n, p in _JOINED.items() if n != "ing"}
_add("pattern_join", lambda spark, sf_dir: pattern_join(_table("documents")(spark, sf_dir).select("doc_id", "text"), "text", _JOINED).select("doc_id", "pattern_name"),
     " UNION ALL ".join(f"SELECT doc_id, '{n}' AS pattern_name FROM documents WHERE regexp_matches(text, '{p}')" for n, p in _JOIN_RE2.items()))
_add("pattern_semi_join", lambda spark, sf_dir: pattern_semi_join(_table("documents")(spark, sf_dir), "text", _rare).select("doc_id"), f"SELECT doc_id FROM documents WHERE {_any}")
_add("pattern_anti_join", lambda spark, sf_dir: pattern_anti_join(_table("documents")(spark, sf_dir), "text", _rare).select("doc_id"), f"SELECT doc_id FROM documents WHERE NOT coalesce({_any}, FALSE)")
_add("top_matches", lambda spark, sf_dir: top_matches(_table("documents")(spark, sf_dir), "text", r"\b[a-z]{4,}\b", 20),
     r"SELECT match, count(*) AS times FROM (SELECT unnest(regexp_extract_all(text, '\b[a-z]{4,}\b')) AS match FROM documents) GROUP BY match ORDER BY times DESC, match LIMIT 20")


def _by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    S.register(spark, "pl_count_words", "count", r"\w+")
    S.register(spark, "pl_has_digits", "is_match", r"\d{2,}")
    _table("conversations")(spark, sf_dir).createOrReplaceTempView("pl_conversations")
    return spark.sql("SELECT role, count(*) AS turns, sum(pl_count_words(text)) AS words, count_if(pl_has_digits(text)) AS with_digits FROM pl_conversations GROUP BY role")


_add("sql_functions", _by_sql, r"SELECT role, count(*) AS turns, sum(len(regexp_extract_all(text, '\w+')))::BIGINT AS words, count(*) FILTER (regexp_matches(text, '\d{2,}')) AS with_digits FROM conversations GROUP BY role")


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windowed_counts(_table("events")(spark, sf_dir), "props", "ts", r'"k": [0-9]*7', by=("event_type",))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return found.select(text("window_start").alias("window_start"), text("window_end").alias("window_end"), "event_type", "rows", "rows_with_match", "matches")


_add("windowed_counts", _windows, """SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(w + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, event_type, count(*) AS rows,
count(*) FILTER (regexp_matches(props, '"k": [0-9]*7')) AS rows_with_match, sum(len(regexp_extract_all(props, '"k": [0-9]*7')))::BIGINT AS matches FROM (SELECT *, date_trunc('hour', ts) AS w FROM events) GROUP BY w, event_type""")  # fmt: skip


def _shown(df: DataFrame) -> DataFrame:
    """Windows as text, so that no time zone shows."""
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("window_start", "window_end")})


_K7 = r'"k": [0-9]*7'
_WINDOW = "strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(e, '%Y-%m-%d %H:%M:%S') AS window_end"
_HITS = f"count(*) AS rows, count(*) FILTER (regexp_matches(props, '{_K7}')) AS rows_with_match, sum(len(regexp_extract_all(props, '{_K7}')))::BIGINT AS matches"
_add("sliding_counts", lambda spark, sf_dir: _shown(windowed_counts(_table("events")(spark, sf_dir), "props", "ts", _K7, width="6 hours", slide="2 hours", by=("event_type",))),
     f"SELECT {_WINDOW}, event_type, {_HITS} FROM (SELECT *, w + INTERVAL 6 HOUR AS e FROM (SELECT *, time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 1 HOUR * unnest([0, 2, 4]) AS w FROM events)) GROUP BY w, e, event_type")
_add("session_counts", lambda spark, sf_dir: _shown(windowed_counts(_table("events")(spark, sf_dir), "props", "ts", _K7, gap="3 hours", by=("user_id",))),
     f"""WITH s AS (SELECT *, sum(CASE WHEN ts >= before + INTERVAL 3 HOUR OR before IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events))
SELECT {_WINDOW}, user_id, rows, rows_with_match, matches FROM (SELECT min(ts) AS w, max(ts) + INTERVAL 3 HOUR AS e, user_id, {_HITS} FROM s GROUP BY user_id, session)""")  # fmt: skip


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three documents of each language with most capitalised words, and the gap to the next one."""
    counted = _table("documents")(spark, sf_dir).select("doc_id", "lang", R.count("text", r"\b[A-Z][a-z]+").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "doc_id")
    ranked = counted.select("*", F.row_number().over(order).alias("place"), (F.col("n") - F.lead("n").over(order)).alias("ahead"))
    return ranked.filter("place <= 3")


_add("ranked_documents", _ranked, r"""SELECT doc_id, lang, n, place::INTEGER AS place, ahead FROM (SELECT *, row_number() OVER o AS place, n - lead(n) OVER o AS ahead
FROM (SELECT doc_id, lang, len(regexp_extract_all(text, '\b[A-Z][a-z]+'))::BIGINT AS n FROM documents) WINDOW o AS (PARTITION BY lang ORDER BY n DESC, doc_id)) WHERE place <= 3""")


def _set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by which of two patterns they hold, as set operations see them."""
    docs = _table("documents")(spark, sf_dir)
    mail, phone = (docs.filter(R.is_match("text", p)).select("doc_id") for p in (PATTERNS["email"], _PHONE))
    kinds = {"both": mail.intersect(phone), "mail_only": mail.exceptAll(phone), "phone_only": phone.subtract(mail), "either": mail.union(phone).distinct()}
    return reduce(DataFrame.unionByName, (found.select(F.lit(kind).alias("kind"), "doc_id") for kind, found in kinds.items()))


_add("set_operations", _set_operations, f"""WITH m AS (SELECT doc_id FROM documents WHERE regexp_matches(text, '{_re2(PATTERNS["email"])}')), p AS (SELECT doc_id FROM documents WHERE regexp_matches(text, '{_re2(_PHONE)}'))
SELECT 'both' AS kind, doc_id FROM m WHERE doc_id IN (SELECT doc_id FROM p) UNION ALL SELECT 'mail_only', doc_id FROM m WHERE doc_id NOT IN (SELECT doc_id FROM p)
UNION ALL SELECT 'phone_only', doc_id FROM p WHERE doc_id NOT IN (SELECT doc_id FROM m) UNION ALL SELECT 'either', doc_id FROM (SELECT doc_id FROM m UNION SELECT doc_id FROM p)""")


def _found_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per quarter and weekday of the date that the library's pattern finds in their text."""
    found = _table("orders")(spark, sf_dir).select(F.to_date(R.find_text(F.concat(F.lit("placed "), F.col("o_orderdate").cast("string")), PATTERNS["dateISO"])).alias("day"))
    return found.groupBy(F.date_format(F.date_trunc("quarter", "day"), "yyyy-MM-dd").alias("quarter"), F.weekday("day").alias("weekday")).agg(F.count(F.lit(1)).alias("orders"), F.max(F.datediff(F.last_day("day"), "day")).alias("left_in_month"))


_add("found_dates", _found_dates, """SELECT strftime(date_trunc('quarter', day), '%Y-%m-%d') AS quarter, (isodow(day) - 1)::INTEGER AS weekday, count(*) AS orders, max(date_diff('day', day, last_day(day)))::INTEGER AS left_in_month
FROM (SELECT regexp_extract('placed ' || o_orderdate::VARCHAR, '[0-9]{4}-[0-9]{2}-[0-9]{2}')::DATE AS day FROM orders) GROUP BY ALL""")


def _grouped_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in texts by language and source, by language, and in all."""
    counted = _table("documents")(spark, sf_dir).select("lang", "source", R.count("text", r"\d+").alias("n"))
    return counted.groupingSets([["lang", "source"], ["lang"], []], "lang", "source").agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("texts"), F.sum("n").alias("numbers"))


_add("grouping_sets", _grouped_sets, r"SELECT lang, source, grouping(lang, source)::INTEGER AS level, count(*) AS texts, sum(len(regexp_extract_all(text, '\d+')))::BIGINT AS numbers FROM documents GROUP BY GROUPING SETS ((lang, source), (lang), ())")


def _pattern_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with each of some hundreds of patterns of a table that occurs in them: words of part names, with an ending."""
    words = _table("part")(spark, sf_dir).select(F.explode(F.split("p_type", " ")).alias("w")).union(_table("benchmark")(spark, sf_dir).select(F.explode(F.split("text", "[^A-Za-z]+")).alias("w")))
    patterns = words.filter("length(w) >= 4").distinct().select(F.col("w").alias("name"), F.concat(F.lit("\\b"), "w", F.lit("[a-z]?\\b")).alias("pattern"))
    return pattern_table_join(_table("documents")(spark, sf_dir).select("doc_id", "text"), "text", patterns).groupBy("pattern_name").agg(F.count(F.lit(1)).alias("texts"))


_add("pattern_table", _pattern_table, r"""WITH w AS (SELECT DISTINCT w FROM (SELECT unnest(string_split(p_type, ' ')) AS w FROM part UNION ALL SELECT unnest(regexp_split_to_array(text, '[^A-Za-z]+')) FROM benchmark) WHERE length(w) >= 4),
t AS (SELECT DISTINCT rn, unnest(regexp_extract_all(text, '\w+')) AS x FROM (SELECT row_number() OVER () AS rn, text FROM documents))
SELECT w AS pattern_name, count(DISTINCT rn) AS texts FROM w JOIN t ON x = w OR (length(x) = length(w) + 1 AND starts_with(x, w) AND regexp_matches(x, '[a-z]$')) GROUP BY w""")


def _turn_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised words of conversation turns, one row each, by a table function."""
    S.register_table(spark, "pl_names", "[A-Z][a-z]+")
    _table("conversations")(spark, sf_dir).createOrReplaceTempView("pl_conversations")
    return spark.sql("SELECT conv_id, turn, ordinal, match FROM pl_conversations, LATERAL pl_names(text)")


_add("table_function", _turn_names, r"SELECT conv_id, turn, (unnest(range(len(m))))::INTEGER AS ordinal, unnest(m) AS match FROM (SELECT conv_id, turn, regexp_extract_all(text, '[A-Z][a-z]+') AS m FROM conversations)")


def _by_sql_verbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replacing, splitting, capturing and line verbs as SQL functions."""
    host = r"://(?<name>[a-z-]+)\.([a-z.]+)"
    for name, verb, options in (("pl_swap", "replace", {"template": "://$2.$1"}), ("pl_host", "capture", {"group": "name"}), ("pl_late", "find_from", {"start": 10})):
        S.register(spark, name, verb, host if verb != "find_from" else "[a-z]+", **options)
    S.register(spark, "pl_parts", "split", r"[/.]+")
    S.register(spark, "pl_headings", "count_matching_lines", r"<h\d>")
    _table("pages")(spark, sf_dir).createOrReplaceTempView("pl_pages")
    return spark.sql("SELECT page_id, pl_swap(url) AS swapped, pl_host(url) AS host, pl_late(url) AS late, size(pl_parts(url)) AS parts, pl_headings(html) AS headings FROM pl_pages")


_add("sql_verbs", _by_sql_verbs, r"""SELECT page_id, regexp_replace(url, '://([a-z-]+)\.([a-z.]+)', '://\2.\1') AS swapped, CASE WHEN regexp_matches(url, '://[a-z-]+\.[a-z.]+') THEN regexp_extract(url, '://([a-z-]+)\.[a-z.]+', 1) END AS host,
nullif(regexp_extract(url[11:], '[a-z]+'), '') AS late, len(regexp_split_to_array(url, '[/.]+'))::INTEGER AS parts, len(list_filter(string_split(html, chr(10)), lambda x: regexp_matches(x, '<h\d>')))::BIGINT AS headings FROM pages""")


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of files, one folder for each role, searched as a tree: matching lines per file."""
    root = f"{ensure_checkpoint_dir(spark)}/tree-{uuid.uuid4().hex}"
    turns = _table("conversations")(spark, sf_dir).select(F.concat(F.col("role"), F.lit("-"), F.col("turn").cast("string")).alias("part"), F.regexp_replace("text", r"[\r\n]+", " ").alias("value"))
    turns.repartition("part").write.partitionBy("part").text(root)
    found = grep(read_tree(spark, root), r"\b[a-z]+ing\b")
    return found.groupBy(F.regexp_extract("path", r"part=([^/]+)/", 1).alias("part")).agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("path").alias("files"))


_add("tree", _tree, r"SELECT role || '-' || turn AS part, count(*) AS lines, 1::BIGINT AS files FROM conversations WHERE regexp_matches(regexp_replace(text, '[\r\n]+', ' ', 'g'), '\b[a-z]+ing\b') GROUP BY part")
