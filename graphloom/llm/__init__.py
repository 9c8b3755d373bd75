"""Operators that prepare text and entities for training data."""
