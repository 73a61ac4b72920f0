"""Operators on tensors, by family."""
