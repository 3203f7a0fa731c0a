"""All registered queries; importing a module registers its queries."""

from textlake.registry import bpe, corpus, extras, harvest, ingest, io, ranking, relational, retrieval, scalar  # noqa: F401
from textlake.registry.base import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
