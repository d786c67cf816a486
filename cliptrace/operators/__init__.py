"""DataFrame operators: scans, alignment, interval algebra, ranking."""
