"""The choice between the tabular and the graph model."""

from .model import DEFAULT_SELECTOR, Selector, fit_selector
from .plan import FEATURES, plan_features

__all__ = ["DEFAULT_SELECTOR", "FEATURES", "Selector", "fit_selector", "plan_features"]
