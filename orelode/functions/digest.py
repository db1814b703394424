"""Fixed-width digests of whole rows, computed in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_digest(columns: list[str]) -> tuple[Column, Column]:
    """128 bits over all ``columns`` as two longs; null differs from every value.

    ``xxhash64`` passes over nulls, so each column is followed by its null flag.
    """
    parts: list[Column] = []
    for c in columns:
        parts += [F.col(f"`{c}`"), F.col(f"`{c}`").isNull()]
    return F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(-7_046_029_254_386_353_131), *parts)
