"""Column expressions: geometry, grid cells and tree paths."""
