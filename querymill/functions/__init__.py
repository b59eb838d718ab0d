"""Column functions: text, SQL text and result equality. All are built from Spark's own functions."""
