"""Column functions: text, similarity and metric scalars."""
