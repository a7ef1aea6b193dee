"""Plan-level helpers: lineage cuts and session settings."""
