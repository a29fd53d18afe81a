"""Every named query with its equivalent SQL, gathered from the modules under ``skein.plans``."""

from skein.plans import build, graph, manifest, questions, search, stream, wiki  # noqa: F401  they register their queries
from skein.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
