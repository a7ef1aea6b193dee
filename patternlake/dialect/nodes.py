"""The pattern tree."""

from __future__ import annotations

from dataclasses import dataclass, field

MAX_CODE = 0x10FFFF


@dataclass(frozen=True)
class Node:
    """Any construct."""

    def children(self) -> tuple[Node, ...]:
        return ()


@dataclass(frozen=True)
class Empty(Node):
    pass


@dataclass(frozen=True)
class Char(Node):
    """``unicode`` folds by the full simple case folding, not within ASCII alone."""

    code: int
    fold: bool = False
    unicode: bool = False


@dataclass(frozen=True)
class Dot(Node):
    dot_all: bool = False
    unicode: bool = False


@dataclass(frozen=True)
class CharSet:
    """Code points: ranges, Java set texts (``\\p{..}`` and nested classes), and how they combine.

    ``op`` is ``or`` (ranges, texts and parts united), ``and`` or ``minus`` (of parts).
    """

    ranges: tuple[tuple[int, int], ...] = ()
    texts: tuple[str, ...] = ()
    parts: tuple[CharSet, ...] = ()
    op: str = "or"
    negated: bool = False


@dataclass(frozen=True)
class Class(Node):
    chars: CharSet
    fold: bool = False
    unicode: bool = False
    strings: tuple[tuple[int, ...], ...] = ()


@dataclass(frozen=True)
class Concat(Node):
    items: tuple[Node, ...]

    def children(self) -> tuple[Node, ...]:
        return self.items


@dataclass(frozen=True)
class Alternation(Node):
    branches: tuple[Node, ...]

    def children(self) -> tuple[Node, ...]:
        return self.branches


@dataclass(frozen=True)
class Repeat(Node):
    child: Node
    least: int
    most: int | None
    greedy: bool = True

    def children(self) -> tuple[Node, ...]:
        return (self.child,)


@dataclass(frozen=True)
class Group(Node):
    """``index`` is None for groups that don't capture."""

    child: Node
    index: int | None = None
    name: str | None = None

    def children(self) -> tuple[Node, ...]:
        return (self.child,)


@dataclass(frozen=True)
class Look(Node):
    child: Node
    ahead: bool = True
    negated: bool = False

    def children(self) -> tuple[Node, ...]:
        return (self.child,)


@dataclass(frozen=True)
class Backref(Node):
    """Candidate group numbers: the first that took part is meant."""

    groups: tuple[int, ...]
    fold: bool = False
    name: str | None = field(default=None, compare=False)


@dataclass(frozen=True)
class Anchor(Node):
    """``kind``: start, end, line_start, line_end, word, not_word."""

    kind: str
    unicode_fold: bool = False


def walk(node: Node):
    yield node
    for child in node.children():
        yield from walk(child)
