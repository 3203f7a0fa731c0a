"""textlake: a Spark-native engine for legal-text corpora.

Every public operator is a function ``(DataFrame, params) -> DataFrame`` built
from DataFrame / SQL / Structured Streaming primitives. Python runs inside
tasks only where no built-in expression exists (recursive chunking, tolerant
markup parsing, vector scoring in bounded blocks).
"""

from textlake.params import Params

__all__ = ["Params"]
