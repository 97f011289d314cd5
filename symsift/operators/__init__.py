"""Operators of the symbol-occurrence engine."""
