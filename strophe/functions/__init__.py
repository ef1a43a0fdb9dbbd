"""functions of the structural text engine."""
