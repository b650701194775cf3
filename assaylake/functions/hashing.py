"""Content hashes on explicit columns.

Canonical form: columns in a stated order, joined by ``|``, null written as ``~``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL_MARK = "~"


def canonical(*cols: Column | str) -> Column:
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(NULL_MARK)) for c in cols]
    return F.concat_ws("|", *parts)


def content_hash(*cols: Column | str) -> Column:
    return F.sha2(canonical(*cols), 256)


def hash32(text: Column, at: int = 1) -> Column:
    """Eight hex digits of SHA-256 (the first, or from place ``at``) as an integer; the same number in any SQL engine."""
    return F.conv(F.substring(F.sha2(text, 256), at, 8), 16, 10).cast("bigint")


def digest_aggs(row_hash32: Column) -> list[Column]:
    """Order-free digest of a set of rows: three small partial aggregates, no collect."""
    return [
        F.count(F.lit(1)).alias("row_count"),
        F.sum(row_hash32).alias("hash_sum"),
        F.bit_xor(row_hash32).alias("hash_xor"),
    ]
