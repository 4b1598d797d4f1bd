"""Functions that queries may import."""
