"""Operators on texts for language model data. Nothing else in the library imports this package."""
