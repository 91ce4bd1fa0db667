"""Part of the tabularium package."""
