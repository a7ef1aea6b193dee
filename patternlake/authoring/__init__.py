"""Writing and judging patterns: builder, library, macros, lint, statistics, printers."""

from patternlake.authoring.builder import Builder, Composer, escape
from patternlake.authoring.library import PATTERNS
from patternlake.authoring.macros import COMMON, Macros

__all__ = ["COMMON", "PATTERNS", "Builder", "Composer", "Macros", "escape"]
