"""Readers of the source types that mappings name."""

from .registry import SourceError, SourceRegistry, default_registry

__all__ = ["SourceError", "SourceRegistry", "default_registry"]
