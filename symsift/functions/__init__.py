"""Functions of the symbol-occurrence engine."""
