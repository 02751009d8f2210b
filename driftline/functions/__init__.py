"""Column functions: geometry, periodic boxes and the selection language."""
