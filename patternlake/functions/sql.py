"""Patterns in SQL: functions with a pattern baked in, and a table function."""

from __future__ import annotations

from pyspark.sql import SparkSession

from patternlake.dialect import CompiledPattern, Flags, compile_pattern
from patternlake.dialect.java import ANY, MARKS, Emitter, template_groups
from patternlake.functions.verbs import _refuse_stale, first_replacement


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r") + "'"


def expression(verb: str, text: str, pattern: str | CompiledPattern, flags: str | Flags | None = None, *, template: str = "", group: int | str = 0, start: int = 0) -> str:
    """SQL of a verb over the expression ``text``.

    ``template`` is for the replacing verbs, ``group`` (number or name) for ``capture`` and
    ``start`` (characters) for ``find_from``.
    """
    p = compile_pattern(pattern, flags)
    java, whole = quoted(p.java), f"regexp_like({text}, {quoted(p.java)})"
    if verb in ("replace", "replace_all"):
        _refuse_stale(p, template_groups(template))
    if verb == "is_match":
        return whole
    if verb == "find":
        return f"CASE WHEN {whole} THEN regexp_extract({text}, {java}, 0) END"
    if verb == "find_from":
        lead = quoted(f"\\A{ANY}{{{start}}}{ANY}*?({Emitter(p.tree, first=1).text})")
        return f"CASE WHEN regexp_like({text}, {lead}) THEN regexp_extract({text}, {lead}, 1) END"
    if verb == "find_all":
        return f"regexp_extract_all({text}, {java}, 0)"
    if verb == "count":
        return f"cast(regexp_count({text}, {java}) AS BIGINT)"
    if verb == "count_matching_lines":
        return f"CASE WHEN {text} IS NOT NULL THEN cast(size(filter(split({text}, '\\n', -1), x -> regexp_like(x, {java}))) AS BIGINT) END"
    if verb == "matching_lines":
        return f"filter(split({text}, '\\n', -1), x -> regexp_like(x, {java}))"
    if verb == "replace_all":
        return f"regexp_replace({text}, {java}, {quoted(p.java_template(template))})"
    if verb == "replace":
        lead, new = first_replacement(p, template)
        return f"regexp_replace({text}, {quoted(lead)}, {quoted(new)})"
    if verb == "split":
        if not p.can_match_empty:
            return f"split({text}, {java}, -1)"
        return f"CASE WHEN NOT contains({text}, '{MARKS[0][0]}') THEN split(regexp_replace({text}, {java}, '{MARKS[0][0]}'), '{MARKS[0][0]}', -1) END"
    if verb == "capture":
        index = group if isinstance(group, int) else p.capture_index(group)
        if index is None or not 0 <= index <= p.group_count:
            raise ValueError(f"no group {group!r} in {p.pattern!r}")
        _refuse_stale(p, {index})
        return f"CASE WHEN {whole} THEN regexp_extract({text}, {java}, {p.group_map[index] if index else 0}) END"
    raise ValueError(f"verb must be one of {sorted(_TYPES)}")


_TYPES = {
    "is_match": "BOOLEAN", "find": "STRING", "find_from": "STRING", "find_all": "ARRAY<STRING>", "count": "BIGINT", "count_matching_lines": "BIGINT", "matching_lines": "ARRAY<STRING>",
    "replace": "STRING", "replace_all": "STRING", "split": "ARRAY<STRING>", "capture": "STRING",
}


def register(spark: SparkSession, name: str, verb: str, pattern: str | CompiledPattern, flags: str | Flags | None = None, **options) -> None:
    """A temporary SQL function ``name(text)``; it is inlined, so plans stay as with columns."""
    body = expression(verb, "t", pattern, flags, **options)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS {_TYPES[verb]} RETURN {body}")


def register_table(spark: SparkSession, name: str, pattern: str | CompiledPattern, flags: str | Flags | None = None) -> None:
    """A temporary table function ``name(text)`` with one row (ordinal, match) per match."""
    body = expression("find_all", f"{name}.t", pattern, flags)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS TABLE (ordinal INT, match STRING) RETURN SELECT pos, col FROM posexplode({body})")
