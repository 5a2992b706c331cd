"""Operators for training data; nothing outside of this folder imports them."""
