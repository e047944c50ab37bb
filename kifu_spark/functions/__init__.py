"""Column functions: text properties, classification, coordinates."""
