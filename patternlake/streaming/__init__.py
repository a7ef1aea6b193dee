"""The verbs on streams: they hold no state, so they work on streaming frames as they are."""

from patternlake.streaming.windows import windowed_counts

__all__ = ["windowed_counts"]
