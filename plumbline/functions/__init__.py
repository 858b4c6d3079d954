"""Column functions and small numerical helpers."""
