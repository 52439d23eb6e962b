"""Spanning forests, as the operators here use them."""

from ..operators.forest import spanning_forest

__all__ = ["spanning_forest"]
