"""Operators for large text-training corpora; nothing else in the library imports this subpackage."""
