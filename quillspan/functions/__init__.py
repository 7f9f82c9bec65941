"""Column expressions made of Spark built-ins."""
