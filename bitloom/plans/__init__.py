"""The library's queries over the driver tables."""

from . import analysis, collections, curves, imports, features, local, merging, provenance, retrieval, semantic, streams  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
