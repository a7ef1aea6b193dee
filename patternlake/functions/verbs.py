"""``is_match``, ``find``, ``find_all``, ``count``, ``replace``, ``split`` and captures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from patternlake.dialect import CompiledPattern, Flags, PatternError, compile_pattern
from patternlake.dialect.java import ANY, MARKS, Emitter
from patternlake.dialect.java import template as java_template
from patternlake.dialect.java import template_groups
from patternlake.functions.exact import exact_find
from patternlake.plans.pushdown import existence
from patternlake.plans.rows import let, running_sums

Pattern = str | CompiledPattern
FlagsLike = str | Flags | None


def _col(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def _group(text: Column, java: Column, n: int) -> Column:
    return F.call_function("regexp_extract", text, java, F.lit(n))


def is_match(text: Column | str, pattern: Pattern, flags: FlagsLike = None) -> Column:
    """Whether the pattern occurs anywhere; literal facts become conjuncts that can be pushed down."""
    return existence(_col(text), compile_pattern(pattern, flags))


def find_text(text: Column | str, pattern: Pattern, flags: FlagsLike = None) -> Column:
    """The text of the leftmost match, null for none."""
    p, text = compile_pattern(pattern, flags), _col(text)
    if not p.can_match_empty:
        return F.regexp_substr(text, F.lit(p.java))
    # The built-in gives null for empty matches.
    return F.when(F.regexp_like(text, F.lit(p.java)), _group(text, F.lit(p.java), 0))


def _lead(java: str) -> str:
    """The leftmost match as group 2, behind what is skipped as group 1."""
    return f"\\A({ANY}*?)({java})"


def _offset(prefix: Column, unit: str) -> Column:
    if unit not in ("char", "byte"):
        raise ValueError("offsets are 'char' or 'byte'")
    return F.length(prefix) if unit == "char" else F.octet_length(prefix)


def _marked(text: Column, build: Callable[[str], Column]) -> Column:
    """``build`` with the first of the sets of marks of which the text holds none.

    The marks are noncharacters, which texts should not hold at all; a text with some of each
    set gives null.
    """
    found = F.lit(None)
    for marks in reversed(MARKS):
        found = F.when(F.regexp_like(text, F.lit(f"[{marks}]")), found).otherwise(build(marks))
    return F.when(text.isNotNull(), found)


def find(text: Column | str, pattern: Pattern, flags: FlagsLike = None, *, offsets: str = "char") -> Column:
    """The leftmost match as struct<match, start, end, captures, capture_spans>, null for none.

    Captures and spans of groups that took no part, in the last round of a repeat, are null.
    ``end`` is exclusive.  One search gives all fields.  Groups inside repeats or look-behinds,
    and optional ones that may be empty, take an Arrow-batched function, as built-in ones say
    neither where a group stood nor in which round; all others stay built-in.
    """
    return _found(_col(text), compile_pattern(pattern, flags), None, offsets)


def find_from(text: Column | str, pattern: Pattern, start: int, flags: FlagsLike = None, *, offsets: str = "char") -> Column:
    """Like ``find``, for the leftmost match at or after character ``start``; anchors and
    look-behind still see the text before it."""
    if start < 0:
        raise ValueError("start must not be negative")
    return _found(_col(text), compile_pattern(pattern, flags), start, offsets)


def _found(text: Column, p: CompiledPattern, skip: int | None, unit: str) -> Column:
    _offset(text, unit)
    form = p.tracked(1 if skip is None else 2)
    if not form.possible:
        return exact_find(p, skip, unit)(text)
    none = F.array().cast("array<string>"), F.array().cast("array<struct<start:int,end:int>>")

    def build(marks: str) -> Column:
        match, group, _ = marks
        lead = f"({form.text})" if skip is None else f"\\A({ANY}{{{skip}}}{ANY}*?)({form.text})"
        fields = f"{match}$1" if skip is None else f"$1{match}$2"
        wanted = sorted({*form.numbers.values(), *(n for b in form.before.values() for n in b)})
        place = {n: k + 1 for k, n in enumerate(wanted)}
        # The match takes the rest of the text along, so one replacement holds all there is to know.
        marked = F.regexp_replace(text, F.lit(f"{lead}{ANY}*+"), F.lit(fields + "".join(f"{group}${n}" for n in wanted)))

        def fields_of(x: Column) -> Column:
            field = lambda k: F.get(x["parts"], F.lit(k))
            begin, own = _offset(x["before"], unit), field(0)
            captures, places = [], []
            for index in range(1, p.group_count + 1):
                held = field(place[form.numbers[index]])
                first = begin
                for n in form.before[index]:
                    first = first + _offset(field(place[n]), unit)
                took_part = F.lit(False) if index in form.never else held != "" if index in form.optional else F.lit(True)
                captures.append(F.when(took_part, held))
                places.append(F.when(took_part, F.struct(first.alias("start"), (first + _offset(held, unit)).alias("end"))))
            return F.struct(
                own.alias("match"), begin.alias("start"), (begin + _offset(own, unit)).alias("end"),
                (F.array(*captures) if captures else none[0]).alias("captures"), (F.array(*places) if places else none[1]).alias("capture_spans"),
            )

        def read(x: Column) -> Column:
            # A third piece is an empty match at the end, behind all that the first has taken.
            parts = F.struct(F.get(x, F.lit(0)).alias("before"), F.split(F.get(x, F.lit(1)), group, -1).alias("parts"))
            return F.when(F.size(x) > 1, let(parts, fields_of))

        return let(F.split(marked, match, -1), read)

    return _marked(text, build)


def find_all_text(text: Column | str, pattern: Pattern, flags: FlagsLike = None) -> Column:
    """The texts of all matches that don't overlap, in order; an empty match moves on by one."""
    return F.regexp_extract_all(_col(text), F.lit(compile_pattern(pattern, flags).java), F.lit(0))


def find_all(text: Column | str, pattern: Pattern, flags: FlagsLike = None, *, offsets: str = "char") -> Column:
    """All matches as array<struct<match, start, end, captures>>; absent captures are ''.

    Matches are marked by one replacement and split apart again, so offsets cost no second
    search; time grows with the number of matches times its logarithm.  Patterns whose captures may be left from
    an earlier round of a repeat are refused: ``find_all_text`` takes them.
    """
    p, text = compile_pattern(pattern, flags), _col(text)
    _refuse_stale(p, range(1, p.group_count + 1))
    _offset(text, offsets)

    def build(marks: str) -> Column:
        match, group, end = marks
        groups = "".join(f"{group}${j}" for _, j in p.numbers)
        marked = F.regexp_replace(text, F.lit(p.java), F.lit(f"{match}$0{groups}{group}{end}"))

        def piece(x: Column) -> Column:
            fields = F.split(F.substring_index(x, end, 1), group, -1)
            return let(fields, lambda f: F.struct(F.get(f, F.lit(0)).alias("own"), _offset(F.get(f, F.lit(0)), offsets).alias("size"), _offset(F.substring_index(x, end, -1), offsets).alias("gap"), F.slice(f, 2, p.group_count).alias("captures")))

        def rows(x: Column) -> Column:
            sizes = F.concat(F.array(x["first"]), F.transform(x["found"], lambda m: m["size"] + m["gap"]))
            return let(F.struct(running_sums(sizes).alias("starts"), x["found"].alias("found")), lambda y: F.transform(y["found"], lambda m, i: F.struct(
                m["own"].alias("match"), F.get(y["starts"], i).alias("start"), (F.get(y["starts"], i) + m["size"]).alias("end"), m["captures"].alias("captures"))))

        return let(F.split(marked, match, -1), lambda pieces: let(F.struct(_offset(F.get(pieces, F.lit(0)), offsets).alias("first"), F.transform(F.slice(pieces, 2, F.size(pieces)), piece).alias("found")), rows))

    return _marked(text, build)


def _refuse_stale(p: CompiledPattern, groups) -> None:
    """Java keeps what a repeated group captured in an earlier round; only ``find`` can tell."""
    if stale := sorted(p.stale_groups & set(groups)):
        raise PatternError("NotImplemented", p.pattern, 0, f"group {stale[0]} may hold the capture of an earlier round of a repeat; find() gives exact captures")


def count(text: Column | str, pattern: Pattern, flags: FlagsLike = None) -> Column:
    """The number of matches, as a long."""
    p, text = compile_pattern(pattern, flags), _col(text)
    if p.exact_literal is not None and p.exact_literal[1:] == (False, False):
        # Plain substrings need no pattern: what their removal takes off tells their number.
        literal = F.lit(p.exact_literal[0])
        return F.floor((F.octet_length(text) - F.octet_length(F.replace(text, literal, F.lit("")))) / F.octet_length(literal)).cast("long")
    found = F.regexp_count(text, F.lit(p.java)).cast("long")
    if len(p.required_literal) >= 2:
        return F.when(F.contains(text, F.lit(p.required_literal)), found).otherwise(F.when(text.isNotNull(), F.lit(0).cast("long")))
    return found


def replace_all(text: Column | str, pattern: Pattern, template: str, flags: FlagsLike = None) -> Column:
    """Every match replaced; ``$0`` to ``$9`` are groups and ``$$`` a dollar."""
    p = compile_pattern(pattern, flags)
    _refuse_stale(p, template_groups(template))
    return F.regexp_replace(_col(text), F.lit(p.java), F.lit(p.java_template(template)))


def replace(text: Column | str, pattern: Pattern, template: str, flags: FlagsLike = None) -> Column:
    """The first match replaced."""
    p = compile_pattern(pattern, flags)
    _refuse_stale(p, template_groups(template))
    lead, new = first_replacement(p, template)
    return F.regexp_replace(_col(text), F.lit(lead), F.lit(new))


def first_replacement(p: CompiledPattern, template: str) -> tuple[str, str]:
    """A Java pattern and template that replace the first match alone."""
    shifted = Emitter(p.tree, first=2)
    whole = java_template(template, {**shifted.numbers, 0: 2})
    separated = f"\\{whole}" if whole[:1].isdigit() else whole  # Java would read "$1" on
    return _lead(shifted.text), f"$1{separated}"


def split(text: Column | str, pattern: Pattern, flags: FlagsLike = None) -> Column:
    """The pieces between matches, empty ones at the edges included."""
    p, text = compile_pattern(pattern, flags), _col(text)
    if not p.can_match_empty:
        return F.split(text, p.java, -1)
    return _marked(text, lambda marks: F.split(F.regexp_replace(text, F.lit(p.java), F.lit(marks[0])), marks[0], -1))


def capture(text: Column | str, pattern: Pattern, group: int | str, flags: FlagsLike = None) -> Column:
    """A group of the first match by number or name; '' if it took no part, null without a match.

    A name that several alternatives use gives the first that is not empty.
    """
    p, text = compile_pattern(pattern, flags), _col(text)
    indexes = (group,) if isinstance(group, int) else p.capture_indexes(group)
    if not indexes or any(not 0 <= i <= p.group_count for i in indexes):
        raise ValueError(f"no group {group!r} in {p.pattern!r}")
    if p.stale_groups & set(indexes):
        exact = find(text, p)
        return F.when(exact.isNotNull(), F.coalesce(*[exact["captures"][i - 1] for i in indexes], F.lit("")))
    found = [_group(text, F.lit(p.java), p.group_map[i] if i else 0) for i in indexes]
    one = found[0] if len(found) == 1 else F.coalesce(*[F.nullif(f, F.lit("")) for f in found], F.lit(""))
    return F.when(F.regexp_like(text, F.lit(p.java)), one)


def captures(text: Column | str, pattern: Pattern, flags: FlagsLike = None) -> Column:
    """All groups of the first match, in order: array<string>, null elements took no part."""
    return find(text, pattern, flags)["captures"]


def named_captures(text: Column | str, pattern: Pattern, flags: FlagsLike = None) -> Column:
    """The named groups of the first match: map<string, string>, null values took no part."""
    p = compile_pattern(pattern, flags)
    names = list(dict.fromkeys(n for n, _ in p.names))

    def of(found: Column) -> Column:
        pairs = [x for n in names for x in (F.lit(n), F.coalesce(*[found["captures"][i - 1] for i in p.capture_indexes(n)]))]
        return F.when(found.isNotNull(), F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>"))

    return let(find(text, p), of)
