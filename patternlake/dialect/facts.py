"""Facts about a tree: lengths, literals, counts."""

from __future__ import annotations

from patternlake.dialect import nodes as N


def lengths(node: N.Node) -> tuple[int, int | None]:
    """Least and most characters of a match; None for no bound."""
    match node:
        case N.Char() | N.Dot():
            return 1, 1
        case N.Class(_, _, _, strings):
            sizes = [1, *map(len, strings)]
            return min(sizes), max(sizes)
        case N.Concat(items):
            all_ = [lengths(i) for i in items]
            return sum(a for a, _ in all_), None if any(b is None for _, b in all_) else sum(b for _, b in all_)
        case N.Alternation(branches):
            all_ = [lengths(b) for b in branches]
            return min(a for a, _ in all_), None if any(b is None for _, b in all_) else max(b for _, b in all_)
        case N.Repeat(child, least, most, _):
            a, b = lengths(child)
            return a * least, 0 if b == 0 or most == 0 else None if b is None or most is None else b * most
        case N.Group(child, _, _):
            return lengths(child)
        case N.Backref():
            return 0, None
    return 0, 0


def _flat(node: N.Node) -> list[N.Node]:
    if isinstance(node, N.Concat):
        return [x for i in node.items for x in _flat(i)]
    if isinstance(node, N.Group):
        return _flat(node.child)
    return [node]


def _runs(node: N.Node) -> list[str]:
    """Literal runs that every match holds, in order; case-folded characters end a run."""
    runs = [""]
    for item in _flat(node):
        if isinstance(item, N.Char) and not item.fold:
            runs[-1] += chr(item.code)
        elif isinstance(item, N.Anchor | N.Look | N.Empty):
            continue
        elif isinstance(item, N.Repeat) and item.least > 0:
            inner = _runs(item.child)
            if item.least == item.most == 1:
                runs += [*inner, ""]
            else:
                runs += ["", *inner, ""]
        else:
            runs.append("")
    return [r for r in runs if r] or [""]


def required_literal(node: N.Node) -> str:
    """The longest literal that every match holds, '' for none."""
    if isinstance(node, N.Alternation):
        return ""
    return max(_runs(node), key=len)


def prefix_literal(node: N.Node) -> str:
    """The literal with which every match begins."""
    out = ""
    for item in _flat(node):
        if isinstance(item, N.Char) and not item.fold:
            out += chr(item.code)
        elif not isinstance(item, N.Anchor) or item.kind not in ("start",):
            break
    return out


def exact_literal(node: N.Node) -> tuple[str, bool, bool] | None:
    """(literal, anchored at the start, at the end) if the pattern is nothing else."""
    items, start, end = _flat(node), False, False
    if any(isinstance(n, N.Group) and n.index is not None for n in N.walk(node)):
        return None
    if items and items[0] == N.Anchor("start"):
        start, items = True, items[1:]
    if items and items[-1] == N.Anchor("end"):
        end, items = True, items[:-1]
    if all(isinstance(i, N.Char) and not i.fold for i in items) and items:
        return "".join(chr(i.code) for i in items), start, end
    return None


def _explicit(chars: N.CharSet) -> bool:
    """Whether a set is given by code points alone, without properties."""
    return not chars.texts and all(map(_explicit, chars.parts))


def around_literal(node: N.Node) -> tuple[str, N.Node, N.Node] | None:
    """The longest run of plain characters, what stands before it and what behind it.

    Every match holds the run, and whether a place of it belongs to a match depends on as many
    characters as ``before`` and ``behind`` can take and one more on either side.  None where it
    may depend on others (look-around, references, ends of the text, open repeats), on case or on
    Unicode properties, or where there is no run.
    """
    for n in N.walk(node):
        match n:
            case N.Look() | N.Backref() | N.Anchor("start" | "end"):
                return None
            case N.Char(_, True, _) | N.Class(_, True, _, _):
                return None
            case N.Class(chars, _, _, _) if not _explicit(chars):
                return None
    items, best, start = _flat(node), (0, 0), 0
    for k, item in enumerate(items):
        if not isinstance(item, N.Char):
            start = k + 1
        elif k + 1 - start > best[1] - best[0]:
            best = (start, k + 1)
    before, behind = N.Concat(tuple(items[: best[0]])), N.Concat(tuple(items[best[1] :]))
    if best == (0, 0) or lengths(before)[1] is None or lengths(behind)[1] is None:
        return None
    return "".join(chr(i.code) for i in items[best[0] : best[1]]), before, behind


def literal_set(node: N.Node) -> tuple[str, ...]:
    """The branches of an alternation of plain literals, () otherwise."""
    while isinstance(node, N.Group) and node.index is None:
        node = node.child
    if not isinstance(node, N.Alternation):
        return ()
    found = [exact_literal(b) for b in node.branches]
    return tuple(f[0] for f in found) if all(f is not None and not f[1] and not f[2] for f in found) else ()


def stale_groups(node: N.Node, inside: bool = False, skipped: bool = False) -> frozenset[int]:
    """Groups that a round of a repeat may leave as an earlier round has set them.

    ``inside`` such a repeat, ``skipped`` by an alternative or an optional part of its rounds.
    """
    found: frozenset[int] = frozenset()
    if isinstance(node, N.Group) and node.index is not None and skipped:
        found = frozenset({node.index})
    skipped = skipped or (inside and (isinstance(node, N.Alternation) or (isinstance(node, N.Repeat) and node.least == 0)))
    inside = inside or (isinstance(node, N.Repeat) and node.most != 1)
    if isinstance(node, N.Look) and not node.ahead:
        return found  # what is behind may have been captured before the round began
    return found.union(*(stale_groups(c, inside, skipped) for c in node.children()))


def never_set(node: N.Node) -> frozenset[int]:
    """Groups inside negative look-around: no match has them."""
    if isinstance(node, N.Look) and node.negated:
        return frozenset(n.index for n in N.walk(node) if isinstance(n, N.Group) and n.index is not None)
    return frozenset().union(*map(never_set, node.children()))


#: What constructs weigh in a pattern's complexity (fixed values): alone, per branch, or as a factor of their child.
WEIGHTS = {"atom": 1, "class": 2, "reference": 5, "branch": 1, "optional": 1, "open": 3, "look": 5, "bound": 10}


def weight(node: N.Node) -> int:
    """Complexity of a tree: repeats and look-around multiply what they hold."""
    inner = sum(map(weight, node.children()))
    if isinstance(node, N.Repeat):
        if node.most is None and node.least < 2:
            return WEIGHTS["open"] * inner
        if (node.least, node.most) == (0, 1):
            return inner + WEIGHTS["optional"]
        return inner * (WEIGHTS["bound"] if node.most is None else node.most)
    if isinstance(node, N.Look):
        return WEIGHTS["look"] * inner
    if isinstance(node, N.Alternation):
        return inner + WEIGHTS["branch"] * (len(node.branches) - 1)
    if isinstance(node, N.Group | N.Concat):
        return inner
    return WEIGHTS["class" if isinstance(node, N.Class) else "reference" if isinstance(node, N.Backref) else "atom"]


def warnings(node: N.Node) -> tuple[str, ...]:
    """What to look at: open repeats whose whole round is a repeat, and captures that only ``find`` can give."""
    found = []
    for n in N.walk(node):
        if isinstance(n, N.Repeat) and n.most is None:
            child = n.child
            while isinstance(child, N.Group):
                child = child.child
            if isinstance(child, N.Repeat):
                found.append("nested quantifiers may take long")
    if stale := sorted(stale_groups(node)):
        found.append(f"groups {', '.join(map(str, stale))} may keep an earlier round's capture outside find()")
    return tuple(found)
