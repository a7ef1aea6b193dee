"""Joins of texts with a table of patterns, by the literals that the patterns' matches hold.

Patterns are checked on the driver, so a table is refused above ``most`` rows.  Each pattern
is entered under its longest required literal; one pass of an Aho-Corasick automaton over a
text finds all places of all literals at once.  Where what stands around a pattern's literal
can take ``REACH`` characters at most and sees no others but their neighbours, the characters
around a place decide.  They are matched with Python's ``regex``, once for all places that look
alike.  All other patterns whose literal is found (and all of them where ``regex`` is missing)
are tried on the whole text by Spark.  Patterns without a literal are tried on every text, and
are few (``MOST_PATTERNS``).

A text leaves the Python worker once, with the numbers of its patterns, and no more than about
``_PART`` characters leave it together; rows are repeated for each pattern by Spark alone, one
after another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patternlake.dialect import CompiledPattern, compile_pattern
from patternlake.dialect.facts import around_literal, lengths
from patternlake.dialect.java import Exact
from patternlake.operators.matches import MOST_PATTERNS
from patternlake.plans.rows import beside, nested, quoted

#: Characters on one side of a literal that may decide.
REACH = 64
_PART = 4 << 20
#: Judged surroundings that a task keeps.
_KNOWN = 200_000


class _Entry(NamedTuple):
    """Pattern ``k`` under its literal: forms for what stands before and behind it, and their reach.

    A form of None needs no look; ``whole`` patterns are tried on the whole text.
    """

    k: int
    whole: bool
    before: str | None = None
    before_reach: int = 0
    behind: str | None = None
    behind_reach: int = 0


def _entry(k: int, p: CompiledPattern) -> tuple[str, _Entry]:
    """The literal of a pattern and its entry."""
    if (parts := around_literal(p.tree)) is not None:
        literal, before, behind = parts
        reach = [lengths(n)[1] for n in (before, behind)]
        if max(reach) <= REACH:
            forms = [Exact(n).text if n.items else None for n in (before, behind)]
            # One character more stands at either end: a part sees it, but doesn't take it.
            first = None if forms[0] is None else f"(?<=(?s:.))(?:{forms[0]})(?=(?s:.)\\Z)"
            last = None if forms[1] is None else f"(?<=\\A(?s:.))(?:{forms[1]})(?=(?s:.))"
            return literal, _Entry(k, False, first, reach[0], last, reach[1])
    return p.exact_literal[0] if p.exact_literal else p.required_literal, _Entry(k, True)


def pattern_table_join(df: DataFrame, text: str, patterns: DataFrame, *, name: str = "name", pattern: str = "pattern", most: int = 100_000) -> DataFrame:
    """The rows of ``df``, once for each pattern that occurs in ``text``, with ``pattern_name``.

    Null names and patterns are left out; a pattern that is there twice joins twice.  A column
    ``pattern_name`` of ``df`` gets an underscore behind its name.
    """
    rows = patterns.select(F.col(quoted(name)).alias("n"), F.col(quoted(pattern)).alias("p")).dropna().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} patterns: split the table")
    compiled = [(k, r.n, compile_pattern(r.p)) for k, r in enumerate(rows)]
    literals: dict[str, list[_Entry]] = {}
    for k, _, p in compiled:
        literal, entry = _entry(k, p)
        literals.setdefault(literal, []).append(entry)
    always = [e.k for e in literals.pop("", [])]
    if len(always) > MOST_PATTERNS:
        raise ValueError(f"{len(always)} patterns without a literal, more than {MOST_PATTERNS}")
    spark = df.sparkSession
    table = spark.createDataFrame([(k, n, p.java) for k, n, p in compiled], f"k int, pattern_name {patterns.schema[name].dataType.simpleString()}, java string")
    # At most ``most`` rows of one pattern each, all of which the driver has held.
    found = nested(df, text=F.col(quoted(text))).filter("text IS NOT NULL")
    kind = T.StructType([T.StructField("row", found.schema["row"].dataType), T.StructField("text", T.StringType()), T.StructField("own", T.ArrayType(T.StructType([T.StructField("k", T.IntegerType()), T.StructField("sure", T.BooleanType())])))])
    found = found.mapInArrow(_probe({w: [tuple(e) for e in es] for w, es in literals.items()}, always), kind)
    found = found.select("row", "text", F.explode("own").alias("own")).select("row", "text", "own.*")
    found = found.join(F.broadcast(table), "k").filter(F.expr("sure OR regexp_like(text, java)"))
    return beside(found, df.columns, ["pattern_name"])


def _probe(literals: dict[str, list[tuple]], always: list[int]):
    """Rows with the patterns that are found in their text (``sure``) or have to be tried on all of it.

    The text itself is left where one has to be tried.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _searcher(literals)

        def part(batch: pa.RecordBatch, rows: list[int], texts: list[str | None], ends: list[int], ks: list[int], sure: list[bool]) -> pa.RecordBatch:
            own = pa.StructArray.from_arrays([pa.array(ks, pa.int32()), pa.array(sure, pa.bool_())], names=["k", "sure"])
            own = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), own)
            return pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(rows, pa.int64())), pa.array(texts, pa.string()), own], names=["row", "text", "own"])

        for batch in batches:
            column, held = batch.column("text"), 0
            rows, texts, ends, ks, sure = [], [], [0], [], []
            for i in range(batch.num_rows):
                text = column[i].as_py()
                found, tried = search(text)
                tried.update(always)
                if found or tried:
                    rows.append(i)
                    texts.append(text if tried else None)
                    ks += [*found, *tried]
                    sure += [True] * len(found) + [False] * len(tried)
                    ends.append(len(ks))
                    held += len(text) + 2 * (len(found) + len(tried))
                if held > _PART:
                    yield part(batch, rows, texts, ends, ks, sure)
                    rows, texts, ends, ks, sure, held = [], [], [0], [], [], 0
            if rows:
                yield part(batch, rows, texts, ends, ks, sure)

    return run


@lru_cache(maxsize=4096)
def _matcher(form: str) -> Callable[[str], object] | None:
    """The search for a form, kept while the worker lives; None where it can't be had."""
    try:
        import regex

        return regex.compile(form, regex.V1).search
    except Exception:  # not installed, or without the construct
        return None


def _places(literals: dict[str, list[tuple]]) -> Callable[[str], Iterator[tuple[int, list[tuple]]]]:
    """A function from texts to the last character and the entries of each literal in them."""
    try:
        import ahocorasick
    except ImportError:

        def places(text: str) -> Iterator[tuple[int, list[tuple]]]:
            for literal, entries in literals.items():
                at = text.find(literal)
                while at >= 0:
                    yield at + len(literal) - 1, entries
                    at = text.find(literal, at + 1)

        return places
    if not literals:
        return lambda text: iter(())
    automaton = ahocorasick.Automaton()
    for literal, entries in literals.items():
        automaton.add_word(literal, entries)
    automaton.make_automaton()
    return automaton.iter


def _searcher(literals: dict[str, list[tuple]]) -> Callable[[str], tuple[set[int], set[int]]]:
    """A function from texts to the patterns in them, and those to be tried whose literals they hold."""
    entries: dict[str, list[tuple]] = {}
    for literal, own in literals.items():
        for k, whole, before, before_reach, behind, behind_reach in own:
            # Where both windows begin and end, told from the literal's last character.
            first = len(literal) - 1
            entries.setdefault(literal, []).append((k, whole, before, first + before_reach + 1, 1 - first, behind, behind_reach + 2))
    places = _places(entries)
    known: dict[tuple[str, str], bool | None] = {}

    def fits(form: str, window: str) -> bool | None:
        """None if it can't be told here."""
        try:
            return known[form, window]
        except KeyError:
            if len(known) >= _KNOWN:
                known.clear()
            matcher = _matcher(form)
            fit = known[form, window] = None if matcher is None else matcher(window) is not None
            return fit

    def search(text: str) -> tuple[set[int], set[int]]:
        found, tried, size = set(), set(), len(text)
        for last, own in places(text):
            for k, whole, before, a, b, behind, c in own:
                if k in found:
                    continue
                if whole:
                    tried.add(k)
                    continue
                # A line feed stands for either end of the text: it is of no word, and lines end there.
                fit = before is None or fits(before, text[last - a : last + b] if last >= a else "\n" + text[: last + b])
                if fit and behind is not None:
                    fit = fits(behind, text[last : last + c] if last + c <= size else text[last:] + "\n")
                if fit:
                    found.add(k)
                elif fit is None:
                    tried.add(k)
        return found, tried - found

    return search
