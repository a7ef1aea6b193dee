"""Recursive-descent parser from pattern text to the tree, with all checks."""

from __future__ import annotations

from dataclasses import replace

from patternlake.dialect import nodes as N
from patternlake.dialect.errors import PatternError
from patternlake.dialect.flags import Flags
from patternlake.dialect.properties import OF_STRINGS, Unavailable, lookup, strings_of

MAX_DEPTH = 512
MAX_BOUND = 2**53 - 1

DIGIT = ((0x30, 0x39),)
WORD = ((0x30, 0x39), (0x41, 0x5A), (0x5F, 0x5F), (0x61, 0x7A))
#: White space of the dialect (fixed values).
SPACE = ((0x09, 0x0D), (0x20, 0x20), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000), (0xFEFF, 0xFEFF))
#: POSIX classes (fixed values, ASCII).
POSIX = {
    "alnum": ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)),
    "alpha": ((0x41, 0x5A), (0x61, 0x7A)),
    "blank": ((0x09, 0x09), (0x20, 0x20)),
    "cntrl": ((0x00, 0x1F), (0x7F, 0x7F)),
    "digit": ((0x30, 0x39),),
    "graph": ((0x21, 0x7E),),
    "lower": ((0x61, 0x7A),),
    "print": ((0x20, 0x7E),),
    "punct": ((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)),
    "space": ((0x09, 0x0D), (0x20, 0x20)),
    "upper": ((0x41, 0x5A),),
    "xdigit": ((0x30, 0x39), (0x41, 0x46), (0x61, 0x66)),
}
_CONTROL = {"n": 0x0A, "t": 0x09, "r": 0x0D, "f": 0x0C, "v": 0x0B}
_SYNTAX = "^$\\.*+?()[]{}|/"


def _is_name(text: str) -> bool:
    return bool(text) and all(c in "_$\u200c\u200d" or c.isidentifier() or (k > 0 and f"a{c}".isidentifier()) for k, c in enumerate(text))


class Parser:
    """One pattern; ``parse()`` gives the tree, ``count`` and ``names`` the groups."""

    def __init__(self, pattern: str, flags: Flags) -> None:
        self.text, self.flags, self.at, self.depth = pattern, flags, 0, 0
        self.count = 0
        self.names: list[tuple[str, int]] = []
        self._total, self._has_names = self._scan()
        self._named_refs: list[tuple[N.Backref, int]] = []

    def fail(self, code: str, detail: str = "", at: int | None = None):
        raise PatternError(code, self.text, min(self.at if at is None else at, len(self.text)), detail)

    def _scan(self) -> tuple[int, bool]:
        """Groups that capture, and whether one has a name, before parsing."""
        total, named, i, inside, depth = 0, False, 0, False, 0
        while i < len(self.text):
            c = self.text[i]
            if c == "\\":
                i += 1
            elif inside:
                inside = c != "]"
            elif c == "[":
                inside = True
            elif c == ")":
                depth = max(depth - 1, 0)
            elif c == "(":
                depth += 1
                if depth > MAX_DEPTH:
                    raise PatternError("NestingTooDeep", self.text, i)
                if not self.text.startswith("?", i + 1):
                    total += 1
                elif self.text.startswith("(?P<", i) or (self.text.startswith("(?<", i) and not self.text.startswith(("(?<=", "(?<!"), i)):
                    total, named = total + 1, True
            i += 1
        return total, named

    # -------------------------------------------------------------- helpers

    def peek(self, text: str) -> bool:
        return self.text.startswith(text, self.at)

    def take(self, text: str) -> bool:
        if self.peek(text):
            self.at += len(text)
            return True
        return False

    def skip_blank(self) -> None:
        while self.flags.extended and self.at < len(self.text):
            if self.text[self.at] in " \t\n\r\f\v":
                self.at += 1
            elif self.text[self.at] == "#":
                end = self.text.find("\n", self.at)
                self.at = len(self.text) if end < 0 else end + 1
            else:
                return

    # -------------------------------------------------------------- structure

    def parse(self) -> N.Node:
        tree = self.alternation()
        if self.at < len(self.text):
            self.fail("UnmatchedParenthesis" if self.peek(")") else "UnexpectedCharacter")
        known = {n for n, _ in self.names}
        for ref, at in self._named_refs:
            if ref.name not in known:
                self.fail("InvalidBackreference", f"no group {ref.name!r}", at)
        self._check_names(tree)
        return self._resolve(tree)

    def _check_names(self, node: N.Node) -> set[str]:
        if isinstance(node, N.Alternation):
            return set().union(*(self._check_names(b) for b in node.branches))
        found: set[str] = set()
        for part in [{node.name}] if isinstance(node, N.Group) and node.name else []:
            found |= part
        for child in node.children():
            own = self._check_names(child)
            if found & own:
                self.fail("DuplicateGroupName", ", ".join(sorted(found & own)), 0)
            found |= own
        return found

    def _resolve(self, node: N.Node) -> N.Node:
        """Named references become numbers, once all names are known."""
        if isinstance(node, N.Backref):
            return replace(node, groups=tuple(i for n, i in self.names if n == node.name)) if node.name is not None else node
        if isinstance(node, N.Concat):
            return N.Concat(tuple(map(self._resolve, node.items)))
        if isinstance(node, N.Alternation):
            return N.Alternation(tuple(map(self._resolve, node.branches)))
        if isinstance(node, N.Repeat | N.Group | N.Look):
            return replace(node, child=self._resolve(node.child))
        return node

    def alternation(self) -> N.Node:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            self.fail("NestingTooDeep")
        outer, branches = self.flags, []
        while True:
            branches.append(self.concat())
            self.flags = outer  # a standalone modifier lasts to the end of its alternative
            if not self.take("|"):
                break
        self.depth -= 1
        return branches[0] if len(branches) == 1 else N.Alternation(tuple(branches))

    def concat(self) -> N.Node:
        items: list[N.Node] = []
        while True:
            self.skip_blank()
            if self.at >= len(self.text) or self.text[self.at] in "|)":
                break
            item = self.repeat()
            if item is not None:
                items.append(item)
        return N.Empty() if not items else items[0] if len(items) == 1 else N.Concat(tuple(items))

    def repeat(self) -> N.Node | None:
        start = self.at
        if self.text[start] in "*+?":
            self.fail("UnexpectedCharacter", "nothing to repeat")
        node = self.atom()
        self.skip_blank()
        bounds = self.bounds()
        if bounds is None:
            return node
        if node is None:
            self.fail("InvalidQuantifier", "nothing to repeat", start)
        if isinstance(node, N.Look) and (not node.ahead or self.flags.full_unicode):
            self.fail("InvalidQuantifier", "look-around can't be repeated", start)
        if isinstance(node, N.Anchor):
            self.fail("InvalidQuantifier", "an anchor can't be repeated", start)
        lazy = self.take("?")
        self.skip_blank()
        at = self.at
        if self.at < len(self.text) and (self.text[at] in "*+?" or self.bounds() is not None):
            self.fail("InvalidQuantifier", "a quantifier of a quantifier", at)
        return N.Repeat(node, *bounds, greedy=lazy == self.swap)

    swap = False

    def bounds(self) -> tuple[int, int | None] | None:
        if self.at >= len(self.text):
            return None
        c = self.text[self.at]
        if c in "*+?":
            self.at += 1
            return {"*": (0, None), "+": (1, None), "?": (0, 1)}[c]
        if c != "{":
            return None
        end = self.text.find("}", self.at)
        low, comma, high = self.text[self.at + 1 : end].partition(",") if end > 0 else ("", "", "")
        if not (low.isascii() and low.isdigit() and (not high or (high.isascii() and high.isdigit()))):
            if self.flags.full_unicode:
                self.fail("InvalidQuantifier")
            return None
        least, most = int(low), int(high) if high else None if comma else int(low)
        if max(least, most or 0) > MAX_BOUND or (most is not None and most < least):
            self.fail("InvalidQuantifier", "bounds out of order or too large")
        self.at = end + 1
        return least, most

    # -------------------------------------------------------------- atoms

    def atom(self) -> N.Node | None:
        c = self.text[self.at]
        if c == "(":
            return self.group()
        if c == "[":
            return self.char_class()
        if c == "\\":
            return self.escape()
        self.at += 1
        f = self.flags
        if c == ".":
            return N.Dot(f.dot_all, f.full_unicode)
        if c == "^":
            return N.Anchor("line_start" if f.multiline else "start")
        if c == "$":
            return N.Anchor("line_end" if f.multiline else "end")
        if c in "{}]" and f.full_unicode:
            self.fail("UnexpectedCharacter", at=self.at - 1)
        return self.char(ord(c))

    def char(self, code: int) -> N.Node:
        return N.Char(code, self.flags.ignore_case, self.flags.ignore_case and self.flags.full_unicode)

    def group(self) -> N.Node | None:
        start, outer, outer_swap = self.at, self.flags, self.swap
        self.at += 1
        index = name = None
        if self.take("?"):
            for mark, ahead, negated in (("=", True, False), ("!", True, True), ("<=", False, False), ("<!", False, True)):
                if self.take(mark):
                    child = self.body(start)
                    self.flags, self.swap = outer, outer_swap
                    return N.Look(child, ahead, negated)
            if self.take("P<") or self.take("<"):
                name = self.group_name()
            elif not self.take(":"):
                if self.modifiers():
                    return None  # (?i) and the like: they stay set
        if name is not None or self.text[start + 1 : start + 2] != "?":
            self.count += 1
            index = self.count
            if name is not None:
                self.names.append((name, index))
        child = self.body(start)
        self.flags, self.swap = outer, outer_swap
        return N.Group(child, index, name)

    def body(self, start: int) -> N.Node:
        child = self.alternation()
        if not self.take(")"):
            self.fail("UnmatchedParenthesis", at=start)
        return child

    def group_name(self) -> str:
        name = ""
        while not self.take(">"):
            if self.at >= len(self.text):
                self.fail("UnexpectedEndOfPattern", "unfinished group name")
            if self.take("\\u"):
                code = self.hex_escape()
                if code is None:
                    self.fail("InvalidEscapeSequence")
                name += chr(code)
            else:
                name += self.text[self.at]
                self.at += 1
        if not _is_name(name):
            self.fail("UnexpectedCharacter", f"{name!r} is no group name")
        return name

    def modifiers(self) -> bool:
        """``(?ims-x:`` or ``(?ims-x)``; true for the latter."""
        on, off, seen, minus = "", "", "", False
        while self.at < len(self.text) and self.text[self.at] not in ":)":
            c = self.text[self.at]
            self.at += 1
            if c == "-" and not minus:
                minus = True
            elif c in "imsxU" and c not in seen:
                seen += c
                on, off = (on, off + c) if minus else (on + c, off)
            else:
                self.fail("UnexpectedCharacter", "bad modifier", self.at - 1)
        if self.at >= len(self.text):
            self.fail("UnexpectedEndOfPattern")
        if not seen:
            self.fail("UnexpectedCharacter", "no modifiers")
        names = {"i": "ignore_case", "m": "multiline", "s": "dot_all", "x": "extended"}
        self.flags = replace(self.flags, **{names[c]: c in on for c in seen if c != "U"})
        if "U" in seen:
            self.swap = "U" in on
        alone = self.text[self.at] == ")"
        self.at += 1
        return alone

    # -------------------------------------------------------------- escapes

    def hex_digits(self, n: int) -> int | None:
        digits = self.text[self.at : self.at + n]
        if len(digits) == n and all(c in "0123456789abcdefABCDEF" for c in digits):
            self.at += n
            return int(digits, 16)
        return None

    def hex_escape(self) -> int | None:
        """After ``\\u``: four digits (a surrogate pair counts as one), or braces under ``u``."""
        if self.flags.full_unicode and self.peek("{"):
            end = self.text.find("}", self.at)
            digits = self.text[self.at + 1 : end] if end > 0 else ""
            if not digits or any(c not in "0123456789abcdefABCDEF" for c in digits) or int(digits, 16) > N.MAX_CODE:
                self.fail("InvalidEscapeSequence")
            self.at = end + 1
            return int(digits, 16)
        code = self.hex_digits(4)
        if code is not None and 0xD800 <= code < 0xDC00 and self.peek("\\u"):
            back = self.at
            self.at += 2
            low = self.hex_digits(4)
            if low is not None and 0xDC00 <= low < 0xE000:
                return 0x10000 + ((code - 0xD800) << 10) + low - 0xDC00
            self.at = back
        return code

    def code_escape(self, in_class: bool) -> int:
        """The code point of a character escape; ``at`` is after the backslash."""
        full, c = self.flags.full_unicode, self.text[self.at]
        self.at += 1
        if c in _CONTROL:
            return _CONTROL[c]
        if c == "b" and in_class:
            return 8
        if c == "c":
            letter = self.text[self.at : self.at + 1]
            if letter.isascii() and letter.isalpha():
                self.at += 1
                return ord(letter) % 32
            if full:
                self.fail("InvalidEscapeSequence")
            self.at -= 1
            return ord("\\")
        if c == "x":
            code = self.hex_digits(2)
        elif c == "u":
            code = self.hex_escape()
        elif c == "0" and not (self.text[self.at : self.at + 1].isdigit()):
            return 0
        elif c in "01234567" and not full:
            digits = c
            while len(digits) < (3 if c in "0123" else 2) and self.text[self.at : self.at + 1] in tuple("01234567"):
                digits += self.text[self.at]
                self.at += 1
            return int(digits, 8)
        elif full and c not in _SYNTAX and not (in_class and c == "-") and not (self.flags.unicode_sets and in_class and c in "&-!#%,:;<=>@`~"):
            self.fail("InvalidEscapeSequence", at=self.at - 2)
        else:
            return ord(c)
        if code is None:
            if full:
                self.fail("InvalidEscapeSequence")
            return ord(c)
        return code

    def set_escape(self, strings: list[tuple[int, ...]]) -> N.CharSet | None:
        """``\\d \\w \\s \\p{..}`` and their complements; ``at`` is after the backslash.

        What a property of strings holds beyond single characters is added to ``strings``.
        """
        c = self.text[self.at]
        known = {"d": DIGIT, "w": WORD, "s": SPACE}
        if c.lower() in known:
            self.at += 1
            ranges = known[c.lower()]
            if c.lower() == "w" and self.flags.full_unicode and self.flags.ignore_case:
                ranges = (*ranges, (0x17F, 0x17F), (0x212A, 0x212A))
            return N.CharSet(ranges, negated=c.isupper())
        if c in "pP" and self.text[self.at + 1 : self.at + 2] == "{":
            end = self.text.find("}", self.at)
            if end < 0:
                self.fail("InvalidEscapeSequence")
            name, negated = self.text[self.at + 2 : end], c == "P"
            if name.startswith("^"):
                name, negated = name[1:], not negated
            try:
                if self.flags.unicode_sets and name in OF_STRINGS:
                    if negated:
                        self.fail("InvalidEscapeSequence", "a property of strings can't be complemented")
                    ranges, longer = strings_of(name)
                    strings += [tuple(map(ord, x)) for x in longer]
                    self.at = end + 1
                    return N.CharSet(ranges)
                found = lookup(name, self.flags.full_unicode)
            except Unavailable:
                self.fail("NotImplemented", f"no library at hand knows {name!r}: start a session first")
            if found is None:
                self.fail("InvalidEscapeSequence", f"unknown property {name!r}")
            self.at = end + 1
            return N.CharSet(found[0], (found[1],) if found[1] else (), negated=negated)
        return None

    def escape(self) -> N.Node:
        start = self.at
        self.at += 1
        if self.at >= len(self.text):
            self.fail("UnexpectedEndOfPattern", "a backslash at the end")
        f, c = self.flags, self.text[self.at]
        if c in "bB":
            self.at += 1
            return N.Anchor("word" if c == "b" else "not_word", f.ignore_case and f.full_unicode)
        if c in "AzZ" and not f.full_unicode and not f.ecmascript:
            self.at += 1
            return N.Anchor("start" if c == "A" else "end")
        if c == "k" and (self._has_names or f.full_unicode):
            self.at += 1
            if not self.take("<"):
                self.fail("InvalidBackreference")
            ref = N.Backref((), f.ignore_case, self.group_name())
            self._named_refs.append((ref, start))
            return ref
        if c in "123456789":
            end = self.at
            while end < len(self.text) and self.text[end].isascii() and self.text[end].isdigit():
                end += 1
            number = int(self.text[self.at : end])
            if number <= self._total:
                self.at = end
                return N.Backref((number,), f.ignore_case)
            if f.full_unicode:
                self.fail("InvalidBackreference")
            if c in "89":
                self.at += 1
                return self.char(ord(c))
        strings: list[tuple[int, ...]] = []
        found = self.set_escape(strings)
        if found is not None:
            return N.Class(found, f.ignore_case, f.full_unicode, tuple(sorted(set(strings), key=lambda s: (-len(s), s))))
        return self.char(self.code_escape(False))

    # -------------------------------------------------------------- classes

    def char_class(self) -> N.Node:
        strings: list[tuple[int, ...]] = []
        found = self.class_body(strings)
        if strings and found.negated:
            self.fail("InvalidCharacterClass", "strings can't be complemented")
        return N.Class(found, self.flags.ignore_case, self.flags.full_unicode, tuple(sorted(set(strings), key=lambda s: (-len(s), s))))

    def class_body(self, strings: list[tuple[int, ...]]) -> N.CharSet:
        start, sets = self.at, self.flags.unicode_sets
        self.at += 1
        negated = self.take("^")
        parts: list[N.CharSet] = []
        op = None
        while True:
            if self.at >= len(self.text):
                self.fail("UnmatchedBracket", at=start)
            if self.take("]"):
                break
            if sets and (self.peek("&&") or self.peek("--")):
                mark = "and" if self.peek("&&") else "minus"
                if not parts or (op or mark) != mark or (op is None and len(parts) > 1):
                    self.fail("InvalidCharacterClass", "mixed set operators")
                op = mark
                self.at += 2
            elif op is not None and len(parts) > 1 and not self._after_operator:
                self.fail("InvalidCharacterClass", "an operator is missing")
            parts.append(self.class_item(strings))
            self._after_operator = sets and (self.peek("&&") or self.peek("--"))
        if op is None:
            return N.CharSet(parts=tuple(parts), negated=negated)
        return N.CharSet(parts=tuple(parts), op=op, negated=negated)

    _after_operator = False

    def class_item(self, strings: list[tuple[int, ...]]) -> N.CharSet:
        if self.flags.unicode_sets and self.peek("["):
            return self.class_body(strings)
        if self.peek("[:"):
            end = self.text.find(":]", self.at)
            name = self.text[self.at + 2 : end] if end > 0 else ""
            if end > 0 and name.lstrip("^").isalpha():
                if name.lstrip("^") not in POSIX:
                    self.fail("InvalidCharacterClass", f"unknown class {name!r}")
                self.at = end + 2
                return N.CharSet(POSIX[name.lstrip("^")], negated=name.startswith("^"))
        if self.flags.unicode_sets and self.take("\\q{"):
            end = self.text.find("}", self.at)
            if end < 0:
                self.fail("InvalidCharacterClass")
            options = [tuple(map(ord, s)) for s in self.text[self.at : end].split("|")]
            self.at = end + 1
            strings += [s for s in options if len(s) != 1]
            return N.CharSet(tuple((s[0], s[0]) for s in options if len(s) == 1))
        start, low = self.at, self.class_atom(strings)
        if self.peek("-") and not self.peek("-]") and not (self.flags.unicode_sets and self.peek("--")):
            back = self.at
            self.at += 1
            if self.at >= len(self.text):
                self.fail("UnmatchedBracket", at=start)
            high = self.class_atom(strings)
            if isinstance(low, int) and isinstance(high, int):
                if high < low:
                    self.fail("InvalidCharacterClass", "range out of order", start)
                return N.CharSet(((low, high),))
            if self.flags.full_unicode:
                self.fail("InvalidCharacterClass", "a set can't end a range", start)
            self.at = back
        return N.CharSet(((low, low),)) if isinstance(low, int) else low

    def class_atom(self, strings: list[tuple[int, ...]]) -> int | N.CharSet:
        if self.take("\\"):
            if self.at >= len(self.text):
                self.fail("UnexpectedEndOfPattern")
            found = self.set_escape(strings)
            return found if found is not None else self.code_escape(True)
        if self.at >= len(self.text):
            self.fail("UnmatchedBracket")
        self.at += 1
        return ord(self.text[self.at - 1])
