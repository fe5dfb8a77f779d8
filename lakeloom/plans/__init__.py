"""Logical planning: stars, source selection, needed variables, join order."""

from .stars import PlanError, Star, StarPlan, plan_group

__all__ = ["PlanError", "Star", "StarPlan", "plan_group"]
