"""Column helpers, and tables and shared intermediate tables as the rest of the library has them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracehound.sources.staging import discard, near, shared_folder, spread, staged, table

__all__ = ["ascii_lower", "discard", "near", "shared_folder", "spread", "staged", "table", "text_key", "text_or_empty"]


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def text_key(column: Column) -> Column:
    """128 bits of SHA-256 over the UTF-8 bytes: equal texts, equal keys, and no two texts known to share one."""
    return F.unhex(F.substring(F.sha2(F.encode(column, "UTF-8"), 256), 1, 32))


def ascii_lower(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
