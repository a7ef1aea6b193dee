"""Rows with columns of any names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """A column name as SQL takes it, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def nested(df: DataFrame, **columns: Column) -> DataFrame:
    """``row`` (all columns of ``df`` as one struct) and ``columns``, so that no name can clash."""
    return df.select(F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("row"), *[c.alias(n) for n, c in columns.items()])


def unnested(df: DataFrame, columns: list[str], **replaced: Column) -> DataFrame:
    """The columns of ``row`` again, some of them ``replaced``."""
    return df.select(*[(replaced[c] if c in replaced else F.col("row").getField(c)).alias(c) for c in columns])


def beside(df: DataFrame, columns: list[str], new: list[str]) -> DataFrame:
    """``columns`` of ``row`` and the columns ``new``; one of a new name gets underscores behind its own."""
    taken, out = {*new}, []
    for c in columns:
        name = c
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(F.col("row").getField(c).alias(name))
    return df.select(*out, *new)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(numbers: Column) -> Column:
    """For each number of an array the sum up to it.

    Sums double their reach in each of log2(n) rounds; a fold would copy the array for every
    element, and take time with the square of its size.
    """
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(numbers) + 1)).cast("int"))

    def step(sums: Column, k: Column) -> Column:
        return F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - F.pow(F.lit(2), k).cast("int")), F.lit(0)))

    return F.aggregate(rounds, numbers, step)
