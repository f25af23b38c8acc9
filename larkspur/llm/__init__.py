"""Operators for preparing language-model training data. Nothing else in larkspur imports this."""
