"""Whole studies built from the operators."""
