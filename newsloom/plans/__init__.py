"""The queries of the engine."""

from . import analyses, clusters, graph, index, labels, registries, resolving, rulings, stories, texts  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
