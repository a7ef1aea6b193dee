"""The pattern dialect: parsed and checked on the driver, emitted as Java patterns."""

from patternlake.dialect.compiled import CompiledPattern, clear_cache, compile_pattern
from patternlake.dialect.errors import PatternError
from patternlake.dialect.flags import Flags

__all__ = ["CompiledPattern", "Flags", "PatternError", "clear_cache", "compile_pattern"]
