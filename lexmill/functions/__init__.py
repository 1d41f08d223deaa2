"""Column functions: text, distances, feature vectors."""
