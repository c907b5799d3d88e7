"""Bounded samples of labelled rows, for fitting alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STEPS = 1 << 30


def by_hash(rows: DataFrame, key: str, group: str, most: int, seed: str = "") -> DataFrame:
    """About `most` rows of each value of `group`, or all where there are no more: those whose key's hash is small.

    The same rows whatever the partitions; null groups are left out. One number for each group reaches the driver.
    """
    counts = {g: n for g, n in rows.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n")).collect()}
    at = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(_STEPS))
    share = F.lit(None).cast("long")
    for g, n in sorted(counts.items(), key=str):
        share = F.when(F.col(group) == F.lit(g), F.lit(min(_STEPS, _STEPS * most // n))).otherwise(share)
    return rows.filter(F.col(group).isNotNull() & (at < share))
