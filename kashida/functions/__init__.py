"""Column functions: text, verse form, similarity."""
