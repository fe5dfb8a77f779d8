"""Mappings from an ontology to sources, and the configuration of the sources."""

from .config import Config, load_config
from .rml import Mapping, TriplesMap, load_mapping

__all__ = ["Config", "Mapping", "TriplesMap", "load_config", "load_mapping"]
