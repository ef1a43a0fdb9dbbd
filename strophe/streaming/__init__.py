"""streaming of the structural text engine."""
