"""Queries by name; importing this package registers them all."""

from . import queries_assembly, queries_duties, queries_model, queries_more, queries_streams, queries_text  # noqa: F401
from .registry import REGISTRY

__all__ = ["REGISTRY"]
