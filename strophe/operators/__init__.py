"""operators of the structural text engine."""
