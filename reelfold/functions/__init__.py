"""Column functions: every one returns a Spark expression, none is a UDF."""
