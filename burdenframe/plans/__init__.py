"""End-to-end commands composed of the operators."""
