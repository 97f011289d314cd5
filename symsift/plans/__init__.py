"""Plans of the symbol-occurrence engine."""
