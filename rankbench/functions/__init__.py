"""Column functions: everything here is a Spark SQL expression."""
