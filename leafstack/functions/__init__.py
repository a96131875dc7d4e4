"""Column builders: geometry, text, scoring and run formatting."""
