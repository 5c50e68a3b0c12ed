"""Plan-level helpers: lineage cuts and sizing."""
