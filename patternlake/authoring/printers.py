"""Statistics and drawings of pattern trees."""

from __future__ import annotations

from patternlake.dialect import CompiledPattern
from patternlake.dialect import nodes as N


def statistics(p: CompiledPattern) -> dict[str, int]:
    def depth(node: N.Node) -> int:
        return 1 + max(map(depth, node.children()), default=0)

    every = list(N.walk(p.tree))
    count = lambda *kinds: sum(isinstance(n, kinds) for n in every)
    return {"nodes": len(every), "depth": depth(p.tree), "literals": count(N.Char), "quantifiers": count(N.Repeat), "groups": count(N.Group), "alternations": count(N.Alternation), "classes": count(N.Class, N.Dot), "anchors": count(N.Anchor)}


def _label(node: N.Node) -> str:
    match node:
        case N.Char(code, fold):
            return f"char {chr(code)!r}{' (any case)' if fold else ''}"
        case N.Repeat(_, least, most, greedy):
            return f"repeat {least}..{'' if most is None else most}{'' if greedy else ' lazy'}"
        case N.Group(_, index, name):
            return "group" if index is None else f"capture {index}{f' {name}' if name else ''}"
        case N.Look(_, ahead, negated):
            return f"{'not ' if negated else ''}{'ahead' if ahead else 'behind'}"
        case N.Backref(groups, _, _):
            return f"reference {', '.join(map(str, groups))}"
        case N.Anchor(kind, _):
            return f"anchor {kind}"
        case N.Class(chars, _, _, _):
            return f"class{' not' if chars.negated else ''}"
    return type(node).__name__.lower()


def tree(p: CompiledPattern) -> str:
    """One line per node, indented by depth."""

    def draw(node: N.Node, level: int) -> list[str]:
        return ["  " * level + _label(node), *(x for c in node.children() for x in draw(c, level + 1))]

    return "\n".join(draw(p.tree, 0))


def s_expression(p: CompiledPattern) -> str:
    def draw(node: N.Node) -> str:
        inner = " ".join(map(draw, node.children()))
        return f"({_label(node)}{' ' + inner if inner else ''})"

    return draw(p.tree)


def dot(p: CompiledPattern) -> str:
    """A Graphviz drawing."""
    lines: list[str] = []

    def draw(node: N.Node) -> int:
        me = len(lines)
        label = _label(node).replace("\\", "\\\\").replace('"', '\\"')
        lines.append(f'  n{me} [label="{label}"];')
        for child in node.children():
            lines.append(f"  n{me} -> n{draw(child)};")
        return me

    draw(p.tree)
    return "digraph pattern {\n" + "\n".join(lines) + "\n}"
