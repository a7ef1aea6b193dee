"""Match rows, counts per group, and joins of texts with tables of patterns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patternlake.dialect import CompiledPattern, Flags, compile_pattern
from patternlake.functions import count, find_all, find_all_text
from patternlake.plans.pushdown import existence
from patternlake.plans.rows import beside, nested, quoted

#: A pattern table becomes one expression per pattern, so it must be a short list.
MOST_PATTERNS = 256


def explode_matches(df: DataFrame, text: str, pattern: str | CompiledPattern, flags: str | Flags | None = None, *, offsets: str = "char") -> DataFrame:
    """One row per match: the other columns, ordinal (from 0), match, start, end, captures.

    Columns of ``df`` with one of the new names get an underscore behind theirs.
    """
    p, column = compile_pattern(pattern, flags), F.col(quoted(text))
    rows = nested(df.filter(existence(column, p)), found=find_all(column, p, offsets=offsets))
    rows = rows.select("row", F.posexplode("found").alias("ordinal", "m")).select("row", "ordinal", "m.*")
    return beside(rows, [c for c in df.columns if c != text], ["ordinal", "match", "start", "end", "captures"])


def match_counts(df: DataFrame, text: str, pattern: str | CompiledPattern, by: list[str], flags: str | Flags | None = None) -> DataFrame:
    """Texts, texts with a match and matches per group; partial sums leave one row per task and group."""
    keys = [F.col(quoted(b)).alias(f"b{k}") for k, b in enumerate(by)]
    # Each text is searched once: a text has a match if it has any.
    counted = df.select(*keys, count(F.col(quoted(text)), compile_pattern(pattern, flags)).alias("n"))
    found = counted.groupBy(*[f"b{k}" for k in range(len(by))]).agg(*count_sums("n"))
    return found.select(*[F.col(f"b{k}").alias(b) for k, b in enumerate(by)], "texts", "texts_with_match", "matches")


def count_sums(n: str) -> list[Column]:
    """Texts, texts_with_match and matches from each text's number of matches."""
    return [F.count(F.lit(1)).alias("texts"), F.count_if(F.col(n) > 0).alias("texts_with_match"), F.coalesce(F.sum(n), F.lit(0).cast("long")).alias("matches")]


def top_matches(df: DataFrame, text: str, pattern: str | CompiledPattern, n: int, flags: str | Flags | None = None) -> DataFrame:
    """The ``n`` most frequent match texts, ties by text."""
    found = df.select(F.explode(find_all_text(text, compile_pattern(pattern, flags))).alias("match"))
    return found.groupBy("match").agg(F.count(F.lit(1)).alias("times")).orderBy(F.desc("times"), "match").limit(n)


def _table(patterns: dict[str, str | CompiledPattern]) -> dict[str, CompiledPattern]:
    if len(patterns) > MOST_PATTERNS:
        raise ValueError(f"{len(patterns)} patterns, more than {MOST_PATTERNS}: split the table")
    return {name: compile_pattern(p) for name, p in patterns.items()}


def _any(text: Column, patterns: dict[str, CompiledPattern]) -> Column:
    return reduce(lambda a, b: a | b, (existence(text, p) for p in patterns.values()), F.lit(False))


def pattern_join(df: DataFrame, text: str, patterns: dict[str, str | CompiledPattern]) -> DataFrame:
    """Texts with each pattern that occurs in them, in column ``pattern_name``.

    The patterns are tested in one pass over the texts, each with its own pushdown facts;
    nothing is shuffled.
    """
    found = F.array_compact(F.array(*[F.when(existence(F.col(text), p), F.lit(name)) for name, p in _table(patterns).items()]))
    return df.select("*", F.explode(found).alias("pattern_name"))


def pattern_semi_join(df: DataFrame, text: str, patterns: dict[str, str | CompiledPattern]) -> DataFrame:
    """Texts in which one of the patterns occurs."""
    return df.filter(_any(F.col(text), _table(patterns)))


def pattern_anti_join(df: DataFrame, text: str, patterns: dict[str, str | CompiledPattern]) -> DataFrame:
    """Texts, null ones included, in which none of the patterns occurs."""
    return df.filter(~F.coalesce(_any(F.col(text), _table(patterns)), F.lit(False)))
