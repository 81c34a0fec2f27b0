"""Column functions (scalar expressions).  All are built-in Spark expressions:
no row UDFs, so they stay inside whole-stage codegen."""
