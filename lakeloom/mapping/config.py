"""Connection options of the sources and weights of the source types."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

# Weights of source types where a configuration gives none; the larger, the sooner joined.
DEFAULT_WEIGHTS = {"csv": 1, "parquet": 2, "rdf": 1, "neo4j": 2, "cassandra": 3, "elasticsearch": 3, "jdbc": 4, "mongodb": 5}


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Config:
    options: dict[str, dict[str, str]] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)

    def options_of(self, source: str) -> dict[str, str]:
        return self.options.get(source, {})

    def weight_of(self, store: str) -> float:
        return self.weights.get(store, DEFAULT_WEIGHTS.get(store, 0))


def load_config(text: str) -> Config:
    """JSON; lines that begin with # are comments."""
    body = "\n".join(line for line in text.splitlines() if not line.lstrip().startswith("#"))
    try:
        data = json.loads(body)
        options = {s["source"]: {k: str(v) for k, v in s.get("options", {}).items()} for s in data.get("sources", [])}
        weights = {w["datasource"].lower(): float(w["weight"]) for w in data.get("weights", [])}
    except (KeyError, TypeError, ValueError) as e:
        raise ConfigError(f"configuration is not as expected: {e}") from None
    return Config(options, weights)
