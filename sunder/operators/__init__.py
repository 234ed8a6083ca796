"""Split operators, one module per family."""
