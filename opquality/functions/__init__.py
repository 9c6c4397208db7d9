"""Column-level helpers; every one stays inside Spark's own expressions."""
