"""Column expressions: text, amounts and dates."""
