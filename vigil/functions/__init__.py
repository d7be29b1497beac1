"""Column functions; the text rules are Spark expressions, never per-row Python."""
