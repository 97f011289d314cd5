"""Sources of the symbol-occurrence engine."""
