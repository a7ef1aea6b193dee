"""Files as text: trees of files, lines, and search results as tables."""

from patternlake.sources.files import grep, grep_counts, read_tree

__all__ = ["grep", "grep_counts", "read_tree"]
