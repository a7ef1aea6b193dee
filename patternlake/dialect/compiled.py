"""Compiled patterns: immutable, made on the driver, and put into plans as literals."""

from __future__ import annotations

import sys
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

from patternlake.dialect import facts
from patternlake.dialect import nodes as N
from patternlake.dialect.errors import PatternError
from patternlake.dialect.flags import Flags
from patternlake.dialect.java import Emitter, Exact, Tracked, template
from patternlake.dialect.parser import Parser
from patternlake.dialect.risk import Risk, assess

_JAVA_BOUND = 2**31 - 1


@dataclass(frozen=True)
class CompiledPattern:
    """A checked pattern with its Java form and what is known about its matches."""

    pattern: str
    flags: Flags
    tree: N.Node = field(repr=False)
    java: str = field(repr=False)
    numbers: tuple[tuple[int, int], ...] = field(repr=False)
    names: tuple[tuple[str, int], ...]
    group_count: int
    risk: Risk = field(repr=False)

    @cached_property
    def group_map(self) -> dict[int, int]:
        return dict(self.numbers)

    @cached_property
    def min_length(self) -> int:
        return facts.lengths(self.tree)[0]

    @cached_property
    def max_length(self) -> int | None:
        return facts.lengths(self.tree)[1]

    @property
    def can_match_empty(self) -> bool:
        return self.min_length == 0

    @property
    def is_finite(self) -> bool:
        return self.max_length is not None

    @cached_property
    def exact_literal(self) -> tuple[str, bool, bool] | None:
        return facts.exact_literal(self.tree)

    @cached_property
    def required_literal(self) -> str:
        return facts.required_literal(self.tree)

    @cached_property
    def literal_prefix(self) -> str:
        return facts.prefix_literal(self.tree)

    @cached_property
    def literal_set(self) -> tuple[str, ...]:
        return facts.literal_set(self.tree)

    @cached_property
    def first_characters(self) -> tuple[str, ...]:
        """Characters with which a match may begin, () where a class or an empty match is possible."""
        prefix = self.literal_prefix[:1]
        if prefix:
            return (prefix,)
        return tuple(sorted({s[:1] for s in self.literal_set})) if all(self.literal_set) else ()

    @cached_property
    def stale_groups(self) -> frozenset[int]:
        """Groups that Java may leave as an earlier round of a repeat has set them; ``find`` clears them."""
        return facts.stale_groups(self.tree)

    @property
    def captures_sticky(self) -> bool:
        return bool(self.stale_groups)

    def capture_index(self, name: str) -> int | None:
        """The first group of a name."""
        return next((i for n, i in self.names if n == name), None)

    def capture_indexes(self, name: str) -> tuple[int, ...]:
        return tuple(i for n, i in self.names if n == name)

    def java_template(self, text: str, shift: int = 0) -> str:
        return template(text, {g: j + shift for g, j in self.numbers})

    def tracked(self, first: int) -> Tracked:
        """The form whose groups' places can be told; ``first`` groups stand before."""
        return Tracked(self.tree, first=first)

    @cached_property
    def exact(self) -> Exact:
        """The form for ``regex`` of Python, which keeps all rounds of a repeat."""
        return Exact(self.tree)

    def describe(self) -> dict:
        return {"pattern": self.pattern, "java": self.java, "groups": self.group_count, "names": dict(self.names), "min_length": self.min_length, "max_length": self.max_length, "can_match_empty": self.can_match_empty, "is_finite": self.is_finite, "risk": self.risk.level, "complexity": facts.weight(self.tree), "warnings": [*facts.warnings(self.tree), *self.risk.issues], "required_literal": self.required_literal, "literal_prefix": self.literal_prefix}


@lru_cache(maxsize=1024)
def _compile(pattern: str, flags: Flags) -> CompiledPattern:
    # The deepest nesting that is allowed takes some four thousand frames.
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 8000))
    parser = Parser(pattern, flags)
    tree = parser.parse()
    for node in N.walk(tree):
        if isinstance(node, N.Repeat) and max(node.least, node.most or 0) > _JAVA_BOUND:
            raise PatternError("InvalidQuantifier", pattern, 0, "bounds above 2 ** 31 - 1")
    risk = assess(tree)
    if risk.above("high") and any(i.startswith("CRITICAL:") for i in risk.issues):
        raise PatternError("PatternTooComplex", pattern, 0, risk.issues[0])
    emitted = Emitter(tree)
    _check_java(pattern, emitted.text)
    return CompiledPattern(pattern, flags, tree, emitted.text, tuple(sorted(emitted.numbers.items())), tuple(parser.names), parser.count, risk)


def _check_java(pattern: str, text: str) -> None:
    """Where a session is at hand, have its JVM compile the pattern before a task does."""
    from py4j.protocol import Py4JJavaError
    from pyspark import SparkContext
    from pyspark.errors import PySparkException

    context = SparkContext._active_spark_context
    if context is None or context._jvm is None:
        return
    try:
        context._jvm.java.util.regex.Pattern.compile(text)
    except (Py4JJavaError, PySparkException) as error:  # PySpark has a class of its own for some
        said = error.java_exception.getMessage() if isinstance(error, Py4JJavaError) else str(error)
        raise PatternError("NotImplemented", pattern, 0, str(said).splitlines()[0]) from None


def compile_pattern(pattern: str | CompiledPattern, flags: str | Flags | None = None) -> CompiledPattern:
    """Parse, check and translate a pattern; the latest ones are kept.

    Raises ``PatternError`` for patterns that are invalid, too risky or not expressible.
    """
    return pattern if isinstance(pattern, CompiledPattern) else _compile(pattern, Flags.of(flags))


def clear_cache() -> None:
    """Forget the compiled patterns that are kept."""
    _compile.cache_clear()
