"""Operators for training-data pipelines; nothing else in tomeflow imports them."""
