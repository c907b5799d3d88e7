"""When calls may begin under a rolling limit, as data: no worker sleeps to find out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .iteration import numbered

#: Turns of a slot that one task orders at once.
TURNS = 1000


def admitted(requests: DataFrame, key: str, at: str, seq: str, calls: int = 20, seconds: int = 60, turns: int = TURNS) -> DataFrame:
    """requests with `begins`: the microsecond in which each one starts if at most `calls` calls of a key start in any
    `seconds` seconds and calls start in the order in which they are asked for.

    at: microseconds (long), seq: unique over the table, for ties. Call k starts at max(at k, start k-calls + seconds), so
    the calls k, k-calls, k-2 calls, ... are a slot that takes turns. With each turn's length taken off, the start is
    the largest `at` up to it: a running maximum, taken over parts of `turns` turns and over the parts' maxima. So a key
    that has all rows is not ordered in one task. Requests without `at` begin at no time and take no turn; those without
    a key share one.
    """
    if calls < 1 or seconds < 0:
        raise ValueError("calls must be 1 or more and seconds 0 or more")
    order = F.struct(F.col(key).alias("key"), F.col(at).alias("at"), F.col(seq).alias("seq"))
    known = requests.filter(F.col(at).isNotNull()).select(order.alias("_order"))
    placed = numbered(known, "_order", "_place").select("_order.*", "_place")
    first = placed.groupBy(F.col("key").alias("_key")).agg(F.min("_place").alias("_first"))
    rank = F.col("_place") - F.col("_first")
    turn = placed.join(first, F.col("key").eqNullSafe(F.col("_key"))).select("key", "at", "seq", F.floor(rank / calls).alias("_turn"), (rank % calls).alias("_slot"))
    length = seconds * 1_000_000
    part = turn.withColumn("_part", F.floor(F.col("_turn") / turns)).withColumn("_at", F.col("at") - F.col("_turn") * length)
    most = part.groupBy("key", "_slot", "_part").agg(F.max("_at").alias("_most"))
    up_to = Window.partitionBy("key", "_slot").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = most.select(F.col("key").alias("_key"), F.col("_slot").alias("_s"), F.col("_part").alias("_p"), F.max("_most").over(up_to).alias("_before"))
    same = F.col("key").eqNullSafe(F.col("_key")) & (F.col("_slot") == F.col("_s")) & (F.col("_part") == F.col("_p"))
    own = F.max("_at").over(Window.partitionBy("key", "_slot", "_part").orderBy("_turn"))
    starts = part.withColumn("_own", own).join(before, same).select(F.col("seq").alias(seq), (F.greatest("_own", "_before") + F.col("_turn") * length).alias("begins"))
    return requests.join(starts, seq, "left")
