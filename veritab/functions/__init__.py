"""Column functions: text, numbers, similarity, extraction."""
