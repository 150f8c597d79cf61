"""Operators for preparing training text, one module each; nothing outside imports them."""
