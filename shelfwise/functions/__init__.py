"""Column functions: markup, text and price rules as native expressions."""
