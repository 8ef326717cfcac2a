"""Column expressions: text, numbers, dates, similarity and fixed vocabulary."""
