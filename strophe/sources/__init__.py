"""sources of the structural text engine."""
