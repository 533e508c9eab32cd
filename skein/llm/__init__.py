"""Operators for text corpora and other training data; nothing else in the library imports this subpackage."""
