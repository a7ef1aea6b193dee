"""The leftmost match with exact captures, for patterns that built-in functions can't place.

Java keeps what a repeated group captured in an earlier round, and Spark doesn't give the
places of groups.  Python's ``regex`` keeps the places of all rounds, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from patternlake.dialect import CompiledPattern, PatternError
from patternlake.dialect.facts import never_set

_TYPE = "match string, start int, end int, captures array<string>, capture_spans array<struct<start:int,end:int>>"


def exact_find(p: CompiledPattern, skip: int | None, unit: str) -> Callable[[Column], Column]:
    """A function of texts; ``skip`` characters at least stand before the match."""
    try:
        import regex

        regex.compile(p.exact.text, regex.V1)
    except Exception as error:  # not installed, or without the construct
        raise PatternError("NotImplemented", p.pattern, 0, "exact captures of this pattern need Python's regex module") from error
    form = p.exact
    never = never_set(p.tree)
    groups = [(form.numbers[i], form.rounds[i], i not in never) for i in range(1, p.group_count + 1)]
    pattern, first = form.text, skip or 0

    @F.pandas_udf(_TYPE)
    def found(texts: pd.Series) -> pd.DataFrame:
        import regex

        search = regex.compile(pattern, regex.V1).search

        def one(text: str | None) -> dict | None:
            m = None if text is None or len(text) < first else search(text, first)
            if m is None:
                return dict.fromkeys(("match", "start", "end", "captures", "capture_spans"))
            at = (lambda k: k) if unit == "char" else (lambda k: len(text[:k].encode()))
            spans = []
            for n, rounds, possible in groups:
                a, b = m.span(n) if possible else (-1, -1)
                # Only the last round of each repeat around a group counts.
                spans.append((a, b) if a >= 0 and all(a >= m.start(r) for r in rounds) else None)
            return {
                "match": m.group(), "start": at(m.start()), "end": at(m.end()),
                "captures": [None if s is None else text[s[0] : s[1]] for s in spans],
                "capture_spans": [None if s is None else {"start": at(s[0]), "end": at(s[1])} for s in spans],
            }

        return pd.DataFrame([one(t) for t in texts], columns=["match", "start", "end", "captures", "capture_spans"])

    def column(text: Column) -> Column:
        struct = found(text)
        return F.when(struct["match"].isNotNull(), struct)

    return column
