"""Column functions over panels."""
