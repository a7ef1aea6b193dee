"""Backtracking risk of a tree, by the ambiguity of its repeats.

A repeat without a (small) bound takes exponential time if there are two ways to read the same
text from some point in it back to that point.  That is asked of its position automaton: states
are the atoms of the repeat, an edge leads from each atom to those that may follow it, and two
runs in step read a common character.  The repeat is ambiguous if an atom follows another for
more than one reason (a round of an inner repeat, or of this one), or if a pair of runs that
starts in one state splits and meets again in it (Weber & Seidl, "On the degree of ambiguity of
finite automata").  Characters are told apart as far as the pattern does: by the ends of all its ranges.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from patternlake.dialect import nodes as N

#: Thresholds of the product (fixed values).
LEVELS = ((1e6, "critical"), (1e4, "high"), (100, "medium"), (10, "low"))
_ORDER = ("safe", "low", "medium", "high", "critical")
#: Repeats of up to so many rounds can't do much harm.
_FEW = 10
#: Automata above so many atoms are not asked; their repeats count as ambiguous if nested.
_MOST_ATOMS = 200


@dataclass(frozen=True)
class Risk:
    level: str
    factor: float
    issues: tuple[str, ...] = ()
    recommendations: tuple[str, ...] = ()

    def above(self, level: str) -> bool:
        return _ORDER.index(self.level) > _ORDER.index(level)


def _sets(chars: N.CharSet):
    yield chars
    for part in chars.parts:
        yield from _sets(part)


class Alphabet:
    """The intervals that a pattern's ranges cut all code points into; sets are bit masks over them."""

    def __init__(self, tree: N.Node) -> None:
        ends = {0, 0x80, N.MAX_CODE + 1}
        for node in N.walk(tree):
            if isinstance(node, N.Char):
                ends |= {e for c in self._cases(node.code, node.fold) for e in (c, c + 1)}
            elif isinstance(node, N.Class):
                ends |= {e for s in _sets(node.chars) for a, b in s.ranges for e in (a, b + 1)}
                ends |= {e for text in node.strings for c in text for e in (c, c + 1)}
        self._starts = sorted(ends)
        self.all = (1 << len(self._starts) - 1) - 1

    @staticmethod
    def _cases(code: int, fold: bool) -> set[int]:
        c = chr(code)
        return {code, *(ord(x) for x in (c.lower(), c.upper()) if len(x) == 1)} if fold else {code}

    def ranges(self, ranges) -> int:
        return sum(1 << k for k, (a, b) in enumerate(zip(self._starts, self._starts[1:], strict=False)) if any(x <= a and b - 1 <= y for x, y in ranges))

    def _property(self, text: str) -> int:
        """Intervals that may hold a character of the property: single ones are looked up."""
        wanted = re.findall(r"\\p\{([A-Z][a-z]?)\}", text)
        if not wanted or text.startswith("\\P"):
            return self.all
        fits = lambda code: any(unicodedata.category(chr(code)).startswith(w) for w in wanted)
        return sum(1 << k for k, (a, b) in enumerate(zip(self._starts, self._starts[1:], strict=False)) if b - a > 128 or any(map(fits, range(a, b))))

    def of(self, chars: N.CharSet) -> int:
        parts = [self.of(p) for p in chars.parts]
        if chars.op == "or":
            found = self.ranges(chars.ranges)
            for more in (*parts, *map(self._property, chars.texts)):
                found |= more
        else:
            found = parts[0]
            for p in parts[1:]:
                found &= p if chars.op == "and" else ~p
        # The complement of an interval that a property may hold in part may hold characters, too.
        return (self.all if any(s.texts for s in _sets(chars)) else self.all & ~found) if chars.negated else found

    def atom(self, node: N.Node) -> int:
        if isinstance(node, N.Char):
            return self.ranges([(c, c) for c in self._cases(node.code, node.fold)])
        if isinstance(node, N.Class):
            return self.all if node.fold and any(s.texts for s in _sets(node.chars)) else self.of(node.chars) | (self._folded(node.chars) if node.fold else 0)
        return self.all

    def _folded(self, chars: N.CharSet) -> int:
        """Letters of the other case, where a set is told by ranges."""
        found = self.of(chars)
        swapped = 0
        for k, (a, b) in enumerate(zip(self._starts, self._starts[1:], strict=False)):
            if found >> k & 1 and b - a <= 128:
                swapped |= self.ranges([(x, x) for c in range(a, b) for x in self._cases(c, True)])
            if found >> k & 1 and b - a > 1:  # part of an interval
                swapped |= sum(1 << m for m, (x, y) in enumerate(zip(self._starts, self._starts[1:], strict=False)) if any(x <= z < y for c in range(a, min(b, a + 128)) for z in self._cases(c, True)))
        return swapped


class Automaton:
    """Atoms of a node, those that a match may begin and end with, and which may follow which."""

    def __init__(self, node: N.Node, alphabet: Alphabet) -> None:
        self._alphabet = alphabet
        self.atoms: list[int] = []
        self.follow: list[set[int]] = []
        self.doubled = False
        first, last, _ = self._build(node)
        self._lead(last, first)  # the repeat itself

    def _lead(self, last: set[int], first: set[int]) -> None:
        for a in last:
            self.doubled = self.doubled or bool(self.follow[a] & first)
            self.follow[a] |= first

    def _add(self, mask: int) -> tuple[set[int], set[int], bool]:
        self.atoms.append(mask)
        self.follow.append(set())
        place = len(self.atoms) - 1
        return {place}, {place}, False

    def _build(self, node: N.Node) -> tuple[set[int], set[int], bool]:
        match node:
            case N.Char() | N.Dot():
                return self._add(self._alphabet.atom(node))
            case N.Class(_, _, _, strings):
                found = self._add(self._alphabet.atom(node))
                for text in strings:
                    found = self._either(found, self._build(N.Concat(tuple(N.Char(c, node.fold) for c in text))))
                return found
            case N.Backref():
                place, _, _ = self._add(self._alphabet.all)
                self.follow[min(place)] |= place
                return place, place, True
            case N.Group(child, _, _):
                return self._build(child)
            case N.Concat(items):
                first, last, empty = set(), set(), True
                for item in items:
                    f, e, nothing = self._build(item)
                    self._lead(last, f)
                    first = first | f if empty else first
                    last = last | e if nothing else e
                    empty = empty and nothing
                return first, last, empty
            case N.Alternation(branches):
                found = self._build(branches[0])
                for b in branches[1:]:
                    found = self._either(found, self._build(b))
                return found
            case N.Repeat(child, least, most, _):
                if most == 0:
                    return set(), set(), True
                first, last, empty = self._build(child)
                if most is None or most > _FEW:
                    self._lead(last, first)
                return first, last, empty or least == 0
        return set(), set(), True

    @staticmethod
    def _either(a, b):
        return a[0] | b[0], a[1] | b[1], a[2] or b[2]

    def ambiguous(self) -> bool:
        """Whether two runs in step can part in a state and meet in it again."""
        n = len(self.atoms)
        if self.doubled or n > _MOST_ATOMS:
            return True
        follow = [sorted(f) for f in self.follow]

        def steps(a: int, b: int):
            for x in follow[a]:
                for y in follow[b]:
                    if self.atoms[x] & self.atoms[y]:
                        yield (x, y)

        def reach(start, edges):
            seen, todo = set(start), list(start)
            while todo:
                for pair in edges.get(todo.pop(), ()):
                    if pair not in seen:
                        seen.add(pair)
                        todo.append(pair)
            return seen

        edges = {(a, b): list(steps(a, b)) for a in range(n) for b in range(n)}
        back: dict[tuple, list] = {}
        for pair, after in edges.items():
            for other in after:
                back.setdefault(other, []).append(pair)
        for s in range(n):
            parted = {(a, b) for a, b in reach([(s, s)], edges) if a != b}
            if parted and parted & reach([(s, s)], back):
                return True
        return False


def _one_set(node: N.Node) -> bool:
    """A repeat of one set alone: a repeat of it is that repeat again, and is translated so."""
    while isinstance(node, N.Group):
        node = node.child
    return isinstance(node, N.Repeat) and isinstance(node.child, N.Class | N.Dot)


def assess(tree: N.Node) -> Risk:
    issues: list[str] = []
    factor, alphabet = 1.0, Alphabet(tree)
    for node in N.walk(tree):
        if isinstance(node, N.Repeat):
            inner = [n for n in N.walk(node.child) if isinstance(n, N.Repeat)]
            unbounded = [n for n in inner if n.most is None or n.most > _FEW]
            if (node.most is not None and node.most <= _FEW) or _one_set(node.child):
                factor *= 2 if inner else 1
            elif inner or any(isinstance(n, N.Alternation) for n in N.walk(node.child)):
                if Automaton(node.child, alphabet).ambiguous():
                    factor *= 1e6
                    issues.append("CRITICAL: nested quantifiers whose rounds can overlap" if unbounded else "HIGH: a repeat whose rounds can overlap")
                elif inner:
                    factor *= 2
        elif isinstance(node, N.Alternation) and len(set(node.branches)) < len(node.branches):
            factor *= 1e4
            issues.append("HIGH: an alternation with equal branches")
    level = next((name for least, name in LEVELS if factor >= least), "safe")
    advice = ("let rounds begin with a character that their end can't match",) if issues else ()
    return Risk(level, factor, tuple(issues), advice)
