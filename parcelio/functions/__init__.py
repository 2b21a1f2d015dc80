"""Column functions: no joins, no shuffles, all inside Spark's own expressions."""
