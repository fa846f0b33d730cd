"""Archives as tables, byte encodings as column functions, on Spark."""
