"""plans of the structural text engine."""
