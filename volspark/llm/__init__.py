"""Operators for the texts of language-model training data."""
