"""Column functions: text, scores, arrays and templates."""
