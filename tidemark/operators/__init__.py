"""Table-level operators: quality, change events, applying them, schemas, ranges, metrics."""
