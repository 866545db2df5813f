"""The query language: text to syntax tree and back."""

from .parser import SyntaxProblem, parse, parse_expression
from .render import render

__all__ = ["SyntaxProblem", "parse", "parse_expression", "render"]
