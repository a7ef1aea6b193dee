"""Line-wise verbs: lines end at line feeds, and a final line feed gives a last empty line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patternlake.dialect import CompiledPattern, Flags, compile_pattern
from patternlake.plans.pushdown import existence
from patternlake.plans.rows import beside, let, nested, quoted, running_sums


def lines(text: Column | str) -> Column:
    """array<string> of a text's lines."""
    return F.split(F.col(text) if isinstance(text, str) else text, "\n", -1)


def is_matching_line(line: Column, pattern: str | CompiledPattern, flags: str | Flags | None = None) -> Column:
    return existence(line, compile_pattern(pattern, flags))


def count_matching_lines(text: Column | str, pattern: str | CompiledPattern, flags: str | Flags | None = None) -> Column:
    """The number of lines with a match, as a long."""
    p = compile_pattern(pattern, flags)
    return F.size(F.filter(lines(text), lambda line: existence(line, p))).cast("long")


def matching_lines(df: DataFrame, text: str, pattern: str | CompiledPattern, flags: str | Flags | None = None) -> DataFrame:
    """One row per matching line: the other columns of ``df``, line_no (from 0), start, end, line.

    ``start`` and ``end`` are bytes in the text.  Columns of ``df`` with one of the new names get
    an underscore behind theirs.  Texts without a literal that every match holds are left out
    at the scan.
    """
    p = compile_pattern(pattern, flags)
    sizes = F.transform(lines(F.col(quoted(text))), lambda x: F.struct(x.alias("line"), F.octet_length(x).alias("size")))

    def placed(every: Column) -> Column:
        ends = running_sums(F.transform(every, lambda x: x["size"] + 1))
        return let(ends, lambda e: F.transform(every, lambda x, i: F.struct(i.alias("line_no"), (F.get(e, i) - x["size"] - 1).alias("start"), (F.get(e, i) - 1).alias("end"), x["line"].alias("line"))))

    # Lines are tested before anything is said about their places.
    found = nested(df.filter(_may_match(df, text, p)), every=let(sizes, placed))
    found = found.select("row", F.explode("every").alias("x")).select("row", "x.*").filter(existence(F.col("line"), p))
    return beside(found, [c for c in df.columns if c != text], ["line_no", "start", "end", "line"])


def _may_match(df: DataFrame, text: str, p: CompiledPattern) -> Column:
    """A condition on whole texts that texts with a matching line meet: a literal that every match holds."""
    literal = p.required_literal if p.exact_literal is None else p.exact_literal[0]
    column = F.col(quoted(text))
    return F.contains(column, F.lit(literal)) if literal and "\n" not in literal else column.isNotNull()
