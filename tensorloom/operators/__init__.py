"""Operators on long-form tensors."""
