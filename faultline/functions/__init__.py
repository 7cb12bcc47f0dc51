"""Column expressions: word lists, text normalisation, risk levels, suggestions."""
