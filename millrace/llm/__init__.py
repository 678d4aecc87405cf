"""Operators for corpora of text; nothing else in the library imports this subpackage."""
