"""Operators that prepare text for language models. Nothing outside imports this package."""
