"""Coverage operators."""
