"""Connected components of pairs of documents: those of the core."""

from ..operators.components import components

__all__ = ["components"]
