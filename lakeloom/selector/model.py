"""A logistic selector over plan features, kept as JSON.

The default was not fitted: both models compile to joins that Catalyst plans, and the tabular
one carries fewer columns, so it is taken unless a fitted selector says otherwise.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .plan import FEATURES


@dataclass(frozen=True)
class Selector:
    """The probability that the graph model is faster."""

    bias: float = -1.0
    weights: tuple[float, ...] = (0.0,) * len(FEATURES)
    threshold: float = 0.5

    def predict(self, features: dict[str, float]) -> float:
        z = self.bias + sum(w * features[f] for w, f in zip(self.weights, FEATURES, strict=True))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))

    def choose(self, features: dict[str, float]) -> str:
        return "graph" if self.predict(features) >= self.threshold else "tabular"

    def to_json(self) -> str:
        return json.dumps({"features": FEATURES, "bias": self.bias, "weights": self.weights, "threshold": self.threshold})

    @classmethod
    def from_json(cls, text: str) -> Selector:
        data = json.loads(text)
        by_name = dict(zip(data["features"], data["weights"], strict=True))
        return cls(data["bias"], tuple(by_name.get(f, 0.0) for f in FEATURES), data["threshold"])


DEFAULT_SELECTOR = Selector()


def fit_selector(log: DataFrame, ridge: float = 0.01) -> Selector:
    """Fit on rows of plan features with tabular_s and graph_s, the seconds that each model took."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = log.select(*[F.col(f).cast("double") for f in FEATURES], (F.col("graph_s") < F.col("tabular_s")).cast("double").alias("label"))
    model = LogisticRegression(regParam=ridge).fit(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows))
    return Selector(float(model.intercept), tuple(float(x) for x in model.coefficients))


def regret(log: DataFrame, selector: Selector) -> dict[str, float]:
    """accuracy, and the seconds lost against the better model of each query; the log is one row a query."""
    rows = [r.asDict() for r in log.collect()]
    lost, right = 0.0, 0
    for r in rows:
        chosen = r["graph_s"] if selector.choose(r) == "graph" else r["tabular_s"]
        best = min(r["graph_s"], r["tabular_s"])
        lost, right = lost + chosen - best, right + (chosen == best)
    return {"accuracy": right / max(1, len(rows)), "lost_s": lost}
