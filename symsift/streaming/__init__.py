"""Streaming of the symbol-occurrence engine."""
