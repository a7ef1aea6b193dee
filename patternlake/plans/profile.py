"""Match figures of a running plan, without a second pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from patternlake.dialect import CompiledPattern, Flags, compile_pattern
from patternlake.functions.verbs import count
from patternlake.plans.rows import nested, quoted, unnested


def observed(df: DataFrame, text: str, pattern: str | CompiledPattern, flags: str | Flags | None = None) -> tuple[DataFrame, Observation]:
    """``df`` and an observation that, once ``df`` has run, holds texts, characters,
    texts_with_match and matches."""
    p, seen = compile_pattern(pattern, flags), Observation()
    column = F.col(quoted(text))
    # Each text is searched once, beside its row.
    rows = nested(df, n=count(column, p), size=F.length(column))
    figures = [
        F.count(F.lit(1)).alias("texts"),
        F.sum("size").alias("characters"),
        F.count_if(F.col("n") > 0).alias("texts_with_match"),
        F.sum("n").alias("matches"),
    ]
    return unnested(rows.observe(seen, *figures), df.columns), seen
