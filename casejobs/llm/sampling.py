"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RANGE = 1 << 31


def hash_sample(rows: DataFrame, limit: int, key: Column) -> DataFrame:
    """At most ``limit`` of the rows, by a hash of their key.

    Each row stays or goes by itself at a rate of ``limit`` over the number of rows, so that about ``limit`` come to the
    final cut whatever the number of partitions; all stay if there are no more than that.
    """
    place = F.xxhash64(key, F.lit(17))
    bound = min(1.0, limit / max(1, rows.count()))
    return rows.where(F.pmod(place, F.lit(_RANGE)) < F.lit(round(bound * _RANGE))).orderBy(place, key).limit(limit)
