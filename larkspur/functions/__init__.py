"""Column functions: text, addresses, coordinates, reference systems and similarity."""
