"""Column expressions: geometry, projection, classification, domain formulae."""
