"""Jobs composed of operators, and shared primitives."""
