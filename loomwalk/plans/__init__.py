"""Registered queries of the library; their SQL is beside them."""

from . import stores, texts, training, vectors
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "stores", "texts", "training", "vectors"]
