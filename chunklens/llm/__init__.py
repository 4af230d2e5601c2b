"""Operators for preparing large-scale training data. Nothing outside imports this package."""
