"""Column functions: colour conversions and scalar arithmetic."""
