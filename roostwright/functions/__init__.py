"""Column functions over listing texts."""
