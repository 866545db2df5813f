"""Multi-model analytics on Spark: documents, relations, graphs, text, vectors and places in one query language."""

from .session import Refused, Session

__all__ = ["Refused", "Session"]
