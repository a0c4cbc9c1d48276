"""Operators that prepare large text collections for model training."""
