"""Helpers shared by the operators: column naming, shared storage, skew handling."""
