"""Column functions: text, identifiers, fixed values."""
