"""The SQL dialect: tokens, syntax, and binding to Spark frames."""
