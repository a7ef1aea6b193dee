"""Match counts over event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patternlake.dialect import CompiledPattern, Flags, compile_pattern
from patternlake.functions import count
from patternlake.plans.rows import quoted


def windowed_counts(df: DataFrame, text: str, time: str, pattern: str | CompiledPattern, flags: str | Flags | None = None, *, width: str = "1 hour", slide: str | None = None, gap: str | None = None, late: str = "1 hour", by: tuple[str, ...] = ()) -> DataFrame:
    """Rows, rows with a match and matches per window (and group); streams drop rows later than ``late``.

    Windows are of ``width``, every ``slide``; with ``gap`` they are sessions, which end where
    nothing comes for so long.  Each text is searched once.
    """
    keys = {f"b{k}": F.col(quoted(b)) for k, b in enumerate(by)}
    at = F.col(quoted(time))
    # Watermarks need a time zone; local times are read in the session's.
    at = at.cast("timestamp") if df.schema[time].dataType.typeName() == "timestamp_ntz" else at
    rows = df.select(at.alias("at"), *[c.alias(n) for n, c in keys.items()], count(F.col(quoted(text)), compile_pattern(pattern, flags)).alias("n"))
    rows = rows.withWatermark("at", late) if df.isStreaming else rows
    window = F.session_window("at", gap) if gap else F.window("at", width, slide) if slide else F.window("at", width)
    found = rows.groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("n") > 0).alias("rows_with_match"), F.sum("n").alias("matches"))
    return found.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[F.col(n).alias(b) for n, b in zip(keys, by, strict=True)], "rows", "rows_with_match", "matches")
