"""Existence tests that data sources and cheap string search can help with."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from patternlake.dialect import CompiledPattern

#: Above so many literals one pattern search beats a chain of substring searches.
MOST_LITERALS = 4


def existence(text: Column, p: CompiledPattern) -> Column:
    """Whether ``p`` occurs in ``text``.

    A plain literal becomes ``contains``, ``startswith``, ``endswith`` or equality, which
    Parquet scans take as filters.  Other patterns keep their search, behind a conjunct for
    a literal that every match holds; conjunctions are split, so the cheap half is pushed.
    """
    if p.exact_literal is not None:
        literal, start, end = p.exact_literal
        wanted = F.lit(literal)
        return text == wanted if start and end else F.startswith(text, wanted) if start else F.endswith(text, wanted) if end else F.contains(text, wanted)
    if 0 < len(p.literal_set) <= MOST_LITERALS and all(p.literal_set):
        return reduce(lambda a, b: a | b, (F.contains(text, F.lit(s)) for s in p.literal_set))
    search = F.regexp_like(text, F.lit(p.java))
    anchored = p.java.startswith("\\A") and p.literal_prefix
    if anchored:
        return F.startswith(text, F.lit(p.literal_prefix)) & search
    if p.required_literal:
        return F.contains(text, F.lit(p.required_literal)) & search
    return search
