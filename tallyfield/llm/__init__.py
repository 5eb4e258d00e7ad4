"""Operators for building training data from large text collections; nothing else in the package imports them."""
