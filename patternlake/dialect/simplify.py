"""Rewrites that keep what a pattern matches and captures."""

from __future__ import annotations

from dataclasses import replace

from patternlake.dialect import nodes as N


def _captures(node: N.Node) -> bool:
    return any(isinstance(n, N.Group) and n.index is not None for n in N.walk(node))


def simplify(node: N.Node) -> N.Node:
    """Fewer nodes: single repeats, empty parts, nested groups, repeats of repeats and equal branches."""
    if isinstance(node, N.Concat):
        items: list[N.Node] = []
        for item in map(simplify, node.items):
            items += item.items if isinstance(item, N.Concat) else [] if isinstance(item, N.Empty) else [item]
        return N.Empty() if not items else items[0] if len(items) == 1 else N.Concat(tuple(items))
    if isinstance(node, N.Alternation):
        # A later branch that equals an earlier one is never reached; captures keep theirs.
        branches: list[N.Node] = []
        for branch in map(simplify, node.branches):
            if branch not in branches or _captures(branch):
                branches.append(branch)
        return branches[0] if len(branches) == 1 else N.Alternation(tuple(branches))
    if isinstance(node, N.Group):
        child = simplify(node.child)
        # The Java form puts its own parentheses where a repeat or a branch needs them.
        return child if node.index is None else replace(node, child=child)
    if isinstance(node, N.Look):
        return replace(node, child=simplify(node.child))
    if isinstance(node, N.Repeat):
        child = simplify(node.child)
        if (node.least, node.most) == (1, 1):
            return child
        if node.most == 0 and not _captures(child):
            return N.Empty()
        if isinstance(child, N.Empty):
            return child
        if isinstance(child, N.Repeat) and child.greedy and node.greedy:
            inner, outer = (child.least, child.most), (node.least, node.most)
            open_, some, may = (0, None), (1, None), (0, 1)
            if inner in (open_, some, may) and outer in (open_, some, may):
                return replace(child, least=0 if 0 in (inner[0], outer[0]) else 1, most=1 if inner == outer == may else None)
        return replace(node, child=child)
    return node
