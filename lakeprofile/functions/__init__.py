"""Column expressions: every function takes and returns Spark columns, none runs Python per row."""
