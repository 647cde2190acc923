"""Operators for preparing training data; nothing outside this folder needs them."""
