"""Column expressions: word predicates, text shaping and vector arithmetic."""
