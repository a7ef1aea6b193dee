"""From the tree to an equivalent ``java.util.regex`` pattern."""

from __future__ import annotations

import re

from patternlake.dialect import nodes as N
from patternlake.dialect.facts import lengths, never_set
from patternlake.dialect.simplify import simplify

ANY = "[\\x{0}-\\x{10FFFF}]"
_W = "[A-Za-z0-9_]"
_W_RANGES = ((0x30, 0x39), (0x41, 0x5A), (0x5F, 0x5F), (0x61, 0x7A))
_W_FOLD = "[A-Za-z0-9_\\x{17F}\\x{212A}]"
#: Two sets of noncharacters that mark matches, groups and ends.
MARKS = ("\ufdd1\ufdd2\ufdd3", "\ufdd9\ufdda\ufddb")
_MANY = 32
_PLAIN = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_ @%&=:;,'\"/<>~`!-")


def char(code: int) -> str:
    return chr(code) if code < 128 and chr(code) in _PLAIN else f"\\x{{{code:X}}}"


def set_text(chars: N.CharSet) -> str:
    """A bracketed Java class; empty sets and their complements have no Java form of their own."""
    if chars.op == "or":
        ranges = [f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in chars.ranges]
        if len(ranges) > _MANY:  # Java tries a class's parts in turn: nest them
            ranges = [f"[{''.join(ranges[k : k + _MANY])}]" for k in range(0, len(ranges), _MANY)]
        inner = "".join(ranges) + "".join(chars.texts) + "".join(set_text(p) for p in chars.parts)
        inner = inner or "[a&&[^a]]"
    elif chars.op == "and":
        inner = "&&".join(set_text(p) for p in chars.parts)
    else:
        inner = set_text(chars.parts[0]) + "".join(f"&&[^{set_text(p)}]" for p in chars.parts[1:])
    # The complement is of the whole nested class, whatever it holds.
    return f"[^[{inner}]]" if chars.negated else f"[{inner}]"


def _ascii_only(chars: N.CharSet) -> bool:
    return not chars.texts and all(b < 128 for _, b in chars.ranges) and all(_ascii_only(p) for p in chars.parts)


class Emitter:
    """Emits one tree.

    ``marked`` groups (those that references name) get an empty group behind them, so that
    a reference to a group that took no part matches empty.  ``numbers`` maps the dialect's
    groups to Java's; ``first`` groups stand before.
    """

    def __init__(self, tree: N.Node, *, first: int = 0) -> None:
        self._next = first
        self.numbers: dict[int, int] = {}
        self._marks: dict[int, int] = {}
        self._marked = {g for n in N.walk(tree) if isinstance(n, N.Backref) for g in n.groups}
        self._assign(tree)
        self.text = self.emit(tree)

    def _assign(self, node: N.Node) -> None:
        if isinstance(node, N.Group) and node.index is not None:
            self._next += 1
            self.numbers[node.index] = self._next
        for child in node.children():
            self._assign(child)
        if isinstance(node, N.Group) and node.index in self._marked:
            self._next += 1
            self._marks[node.index] = self._next

    def emit(self, node: N.Node) -> str:
        match node:
            case N.Empty():
                return "(?:)"
            case N.Char(code, fold, unicode):
                if fold and chr(code).lower() != chr(code).upper():
                    return f"(?{'i' if code < 128 and not unicode else 'iu'}:{char(code)})"
                return char(code)
            case N.Dot(dot_all, unicode):
                top = "10FFFF" if unicode or dot_all else "FFFF"
                skip = "" if dot_all else "&&[^\\n\\r\\x{2028}\\x{2029}]"
                return f"[\\x{{0}}-\\x{{{top}}}{skip}]"
            case N.Class(chars, fold, unicode, strings):
                text = set_text(chars)
                if strings:
                    text = "(?:" + "|".join(["".join(map(char, s)) for s in strings if s] + [text] + [""] * any(not s for s in strings)) + ")"
                if not fold:
                    return text
                return f"(?{'i' if _ascii_only(chars) and not unicode else 'iu'}:{text})"
            case N.Concat(items):
                out = []
                for k, item in enumerate(items):
                    before = self._wordly(items[k - 1], -1) if k else None
                    after = self._wordly(items[k + 1], 0) if k + 1 < len(items) else None
                    if isinstance(item, N.Anchor) and item.kind == "word" and (before is not None or after is not None):
                        out.append(self._edge(before, after, item.unicode_fold))
                    else:
                        out.append(self.emit(item))
                return "".join(out)
            case N.Alternation(branches):
                return "(?:" + "|".join("" if isinstance(b, N.Empty) else self.emit(b) for b in branches) + ")"
            case N.Repeat(N.Group(N.Repeat(), None, _)) if isinstance(plain := simplify(node), N.Repeat) and not isinstance(plain.child, N.Repeat) and plain != node:
                return self.emit(plain)
            case N.Repeat(child, least, most, greedy):
                text = self.emit(child)
                if isinstance(child, N.Concat | N.Repeat | N.Look | N.Backref) or (isinstance(child, N.Group) and child.index is not None and child.index in self._marked):
                    text = f"(?:{text})"
                mark = {(0, None): "*", (1, None): "+", (0, 1): "?"}.get((least, most)) or (f"{{{least}}}" if least == most else f"{{{least},{'' if most is None else most}}}")
                return text + mark + ("" if greedy else "?")
            case N.Group(child, index, _):
                if index is None:
                    return f"(?:{self.emit(child)})"
                return f"({self.emit(child)})" + ("()" if index in self._marked else "")
            case N.Look(child, ahead, negated):
                return f"(?{'' if ahead else '<'}{'!' if negated else '='}{self.emit(child)})"
            case N.Backref(groups, fold, _):
                options = []
                for k, g in enumerate(groups):
                    if g in self._marks:
                        earlier = "".join(f"(?!\\{self._marks[x]})" for x in groups[:k] if x in self._marks)
                        options.append(f"{earlier}(?:\\{self.numbers[g]})")
                unset = "".join(f"(?!\\{self._marks[g]})" for g in groups if g in self._marks)
                text = "(?:" + "|".join([*options, unset]) + ")"
                return f"(?iu:{text})" if fold else text
            case N.Anchor(kind, fold):
                return self.anchor(kind, fold)
        raise TypeError(node)

    def _wordly(self, node: N.Node, end: int) -> bool | None:
        """Whether all matches of ``node`` begin (0) or end (-1) with a word character, or none does; None if neither."""
        if isinstance(node, N.Char):
            return None if node.fold else any(a <= node.code <= b for a, b in _W_RANGES)
        if isinstance(node, N.Class):
            c = node.chars
            while c.op == "or" and not c.negated and not c.ranges and not c.texts and len(c.parts) == 1:
                c = c.parts[0]
            if node.fold or node.strings or c.op != "or" or c.negated or c.texts or c.parts or not c.ranges:
                return None
            inside = [any(a <= x and y <= b for a, b in _W_RANGES) for x, y in c.ranges]
            outside = [all(y < a or x > b for a, b in _W_RANGES) for x, y in c.ranges]
            return True if all(inside) else False if all(outside) else None
        if isinstance(node, N.Repeat) and node.least > 0 or isinstance(node, N.Group):
            return self._wordly(node.child, end)
        if isinstance(node, N.Concat):
            return self._wordly(node.items[end], end)
        return None

    def _edge(self, before: bool | None, after: bool | None, fold: bool) -> str:
        """A word boundary next to something that is known to be, or not to be, of a word."""
        w = _W_FOLD if fold else _W
        if after is not None:
            return f"(?<!{w})" if after else f"(?<={w})"
        return f"(?!{w})" if before else f"(?={w})"

    def anchor(self, kind: str, fold: bool) -> str:
        w = _W_FOLD if fold else _W
        return {
            "start": "\\A",
            "end": "\\z",
            "line_start": "(?<![^\\n])",
            "line_end": "(?![^\\n])",
            "word": f"(?:(?<={w})(?!{w})|(?<!{w})(?={w}))",
            "not_word": f"(?:(?<={w})(?={w})|(?<!{w})(?!{w}))",
        }[kind]


class Tracked(Emitter):
    """Emits a tree so that the place of each group follows from the lengths of others.

    What stands before a group, in its own sequence and those around it, is captured as well;
    ``before`` has those Java groups.  ``optional`` groups may take no part in a match; as they
    can't be empty, an empty one took none.  ``possible`` is false where that doesn't do: for
    groups that repeats or look-behinds hold, or that are optional and may be empty.  Nothing
    that a negative look-ahead captures (``never``) is left.
    """

    def __init__(self, tree: N.Node, *, first: int = 0) -> None:
        self.before: dict[int, tuple[int, ...]] = {}
        self.optional: set[int] = set()
        self.possible = True
        self.never = never_set(tree)
        self._numbered = first
        super().__init__(tree, first=first)
        self.text = self._track(tree, (), False)

    def _assign(self, node: N.Node) -> None:
        """Numbers are given while groups are written."""

    @staticmethod
    def _captures(node: N.Node) -> bool:
        return any(isinstance(n, N.Group) and n.index is not None for n in N.walk(node))

    def _open(self) -> int:
        self._numbered += 1
        return self._numbered

    def _track(self, node: N.Node, before: tuple[int, ...], optional: bool) -> str:
        if not self._captures(node):
            return self.emit(node)
        match node:
            case N.Group(child, index, _):
                if index is None:
                    return f"(?:{self._track(child, before, optional)})"
                number = self._open()
                self.numbers[index], self.before[index] = number, before
                if optional:
                    self.optional.add(index)
                    self.possible = self.possible and lengths(child)[0] > 0
                text = f"({self._track(child, before, optional)})"
                if index in self._marked:
                    self._marks[index] = self._open()
                    text += "()"
                return text
            case N.Concat(items):
                out, k = [], 0
                last = max(i for i, item in enumerate(items) if self._captures(item))
                while k < len(items):
                    end = k
                    while end < len(items) and not self._captures(items[end]):
                        end += 1
                    if end > k:  # a run without captures
                        run = self._open() if k < last else None
                        text = self.emit(N.Concat(items[k:end]))
                        out.append(text if run is None else f"({text})")
                        before = before if run is None else (*before, run)
                        k = end
                        continue
                    item = items[k]
                    if isinstance(item, N.Look) or k == last:
                        text = self._track(item, before, optional)
                        out.append(f"(?:{text})" if isinstance(item, N.Alternation) else text)
                    elif isinstance(item, N.Group) and item.index is not None:
                        out.append(self._track(item, before, optional))
                        before = (*before, self.numbers[item.index])
                    else:
                        run = self._open()
                        out.append(f"({self._track(item, before, optional)})")
                        before = (*before, run)
                    k += 1
                return "".join(out)
            case N.Alternation(branches):
                return "(?:" + "|".join(self._track(b, before, True) for b in branches) + ")"
            case N.Repeat(child, least, 1, greedy):
                return f"(?:{self._track(child, before, optional or least == 0)})" + ("" if least else "?" if greedy else "??")
            case N.Look(child, True, negated):
                if not negated and optional:  # Java keeps its captures when the way through it fails
                    self.possible = False
                return f"(?{'!' if negated else '='}{self._track(child, before, optional)})"
        self.possible = False
        for n in N.walk(node):  # their text is not used
            if isinstance(n, N.Group) and n.index is not None:
                self.numbers[n.index] = self._open()
        return ""


class Exact(Emitter):
    """Emits a tree for Python's ``regex``, with a group around each round of a repeat that holds captures.

    ``rounds`` has those around each group; ``numbers`` are the groups' own.
    """

    def __init__(self, tree: N.Node) -> None:
        self.rounds: dict[int, tuple[int, ...]] = {}
        self._around: dict[int, int] = {}
        super().__init__(tree)
        text = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08X}", self.text)
        self.text = text.replace("\\z", "\\Z").replace("\\p{Is", "\\p{").replace("\\p{javaUnicodeIdentifierStart}", "\\p{ID_Start}").replace("(?iu:", "(?i:")

    def _assign(self, node: N.Node, rounds: tuple[int, ...] = ()) -> None:
        if isinstance(node, N.Repeat) and node.most != 1 and Tracked._captures(node):
            self._next += 1
            self._around[id(node.child)] = self._next
            rounds = (*rounds, self._next)
        if isinstance(node, N.Group) and node.index is not None:
            self._next += 1
            self.numbers[node.index], self.rounds[node.index] = self._next, rounds
        behind = isinstance(node, N.Look) and not node.ahead
        for child in node.children():
            self._assign(child, () if behind else rounds)
        if isinstance(node, N.Group) and node.index in self._marked:
            self._next += 1
            self._marks[node.index] = self._next

    def emit(self, node: N.Node) -> str:
        text = super().emit(node)
        return f"({text})" if id(node) in self._around else text


def template(text: str, numbers: dict[int, int]) -> str:
    """A replacement template as Java's: ``$$``, ``$0`` to ``$9``; others are literal.

    ``numbers`` may give group 0 another number, where the match is a group itself.
    """
    out, i = "", 0
    while i < len(text):
        c, after = text[i], text[i + 1 : i + 2]
        if c == "$" and after == "$":
            out, i = out + "\\$", i + 2
        elif c == "$" and after.isascii() and after.isdigit() and (after == "0" or int(after) in numbers):
            group = numbers.get(int(after), 0)
            follows = text[i + 2 : i + 3]
            # Java would read on: an escaped digit ends the number.
            out += f"${group}" + (f"\\{follows}" if follows.isascii() and follows.isdigit() else "")
            i += 3 if follows.isascii() and follows.isdigit() else 2
        else:
            out, i = out + ("\\" + c if c in "$\\" else c), i + 1
    return out


def template_groups(text: str) -> set[int]:
    """The groups that a replacement template names."""
    return {int(g) for g in re.findall(r"\$(?:\$|([0-9]))", text) if g}
