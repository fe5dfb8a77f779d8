"""The query language: tokens, syntax tree and parser."""

from .parser import QueryError, parse_query

__all__ = ["QueryError", "parse_query"]
