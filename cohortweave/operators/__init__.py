"""Operators: one module per family of the inventory."""
