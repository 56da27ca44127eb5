"""Column functions: numbers, text and plane geometry."""
