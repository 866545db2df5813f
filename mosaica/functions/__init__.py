"""Scalar functions by name. Each takes typed values and gives one; all are Column expressions, so queries stay in the JVM."""

from . import arrays, geo, maths, misc, objects, strings, times, types, vectors  # noqa: F401
from .registry import FUNCTIONS, call, constant

__all__ = ["FUNCTIONS", "call", "constant"]
