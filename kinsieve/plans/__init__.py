"""Composite plans built from the operators."""
