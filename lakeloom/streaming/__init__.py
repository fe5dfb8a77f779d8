"""Queries over growing sources: a star of type `stream` makes the whole result a stream."""

from .runner import run_available

__all__ = ["run_available"]
