"""Operators that prepare training text: tokens, near copies, quality, mixing, search."""
