"""End-to-end analyses composed of the operators."""
