"""Scalar functions: join transformations and filter expressions."""

from .expressions import compile_expr, compile_filter
from .transforms import apply_calls

__all__ = ["apply_calls", "compile_expr", "compile_filter"]
