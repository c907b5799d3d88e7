"""Shards of nearly equal bytes by longest-processing-time scheduling.

Documents with equal texts form a group and stay together. Groups in descending order of size go to the shard that has
the least so far, which a heap gives. Groups of one size are alike to the scheduler, so it works on counts by size: what
the heap would give to each shard for a run of equal groups is computed at once. Sizes from PRECISE on are compared by
their leading bits, so that there are at most some ten thousand runs for any corpus; a run counts with the mean of its
sizes. Groups get ranks among those of their size from counts by (size, slice), and shards own ranges of ranks. No task
sees all groups, nothing but the runs reaches the driver, and no key holds more than a slice of a group's documents.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Sizes below are told apart exactly; larger ones by as many leading values, a thousandth of their size.
PRECISE = 2048
#: Rows that a slice should hold about, and the most slices.
SLICE, MOST_SLICES = 50_000, 1 << 20
#: A group with more than this share of all documents is joined by broadcast; there are fewer than its inverse.
HOT = 1 / 1000


def deal(loads: list[int], size: int, count: int) -> list[int]:
    """How many of `count` groups of one size each shard gets, if each goes to the least loaded shard, the smallest
    number first; loads grow accordingly.

    The loads at which shard s takes a group are loads[s], loads[s] + size, ...; the heap pops the `count` smallest of
    all these.
    """
    low, high = min(loads), min(loads) + size * count
    while low < high:  # the smallest level up to which there are `count` of them
        level = (low + high) // 2
        if sum((level - x) // size + 1 for x in loads if x <= level) >= count:
            high = level
        else:
            low = level + 1
    given = [max(0, (low - 1 - x) // size + 1) for x in loads]
    rest = count - sum(given)
    for s, x in enumerate(loads):
        if rest and x + given[s] * size == low:
            given[s] += 1
            rest -= 1
    for s, k in enumerate(given):
        loads[s] += k * size
    return given


def schedule(runs: list[tuple[int, int, int]], shards: int) -> dict[int, list[int]]:
    """For each run (key, groups, total size) how many of its groups each shard gets; runs in descending order of their
    groups' sizes."""
    loads = [0] * shards
    heap = [(0, s) for s in range(shards)]
    plan = {}
    for key, count, total in sorted(runs, key=lambda r: (-r[2] / r[1], r[0])):
        if count == 1:
            load, s = heap[0]
            heapq.heapreplace(heap, (load + total, s))
            loads[s] = load + total
            plan[key] = [int(i == s) for i in range(shards)]
        else:
            plan[key] = deal(loads, max(1, round(total / count)), count)
            heap = [(x, s) for s, x in enumerate(loads)]
            heapq.heapify(heap)
    return plan


def run_key(size: Column) -> Column:
    """A size as its leading bits, exact below PRECISE."""
    cut = F.greatest(F.lit(0), F.length(F.bin(size)) - F.lit((PRECISE - 1).bit_length()))
    return cut.cast("long") * PRECISE + F.call_function("shiftright", size, cut)


def _ranked(df: DataFrame, key: str, slices: int, by: list[str], name: str) -> DataFrame:
    """df with gapless ranks from 0 among the rows of a key, whose rows are dealt over slices."""
    cut = df.withColumn("slice", F.pmod(F.xxhash64(*by), F.lit(slices)))
    counts = cut.groupBy(key, "slice").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy(key).orderBy("slice")) - F.col("n")).drop("n")
    own = F.row_number().over(Window.partitionBy(key, "slice").orderBy(*by)) - 1
    return cut.withColumn("own", own).join(before, [key, "slice"]).withColumn(name, (F.col("before") + F.col("own")).cast("long")).drop("slice", "own", "before")


def shard(docs: DataFrame, shards: int = 16, with_text: bool = False) -> DataFrame:
    """Deal all rows of docs(doc_id, text) into shards of nearly equal size.

    Returns doc_id, size (bytes of the text and 1), text_crc32, shard and slot (the place in the shard, gapless from 0),
    with_text the text, too. Rows with equal texts are in one shard; a null text is an empty one (size 1, crc 0). Rows
    with equal doc_ids are dealt each on its own; further columns are ignored; an empty table gives no rows. Texts are
    told apart by size, CRC-32 and a 64-bit hash; should two texts agree in all, they stay together.
    """
    text = F.coalesce("text", F.lit(""))
    size = (F.octet_length(text) + F.lit(1)).cast("long")
    keyed = docs.select(F.monotonically_increasing_id().alias("row_key"), "doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("text_hash"), *["text"] * with_text)
    thin = written(keyed)  # row keys are fixed from here on
    same = ["text_hash", "text_crc32", "size"]
    found = thin.groupBy(*same).agg(F.count("*").alias("copies"))
    groups = written(found.withColumn("total", F.col("size") * F.col("copies")).withColumn("run", run_key(F.col("total"))))
    runs = groups.groupBy("run").agg(F.count("*").alias("groups"), F.sum("total").alias("total"), F.sum("copies").alias("rows")).collect()
    rows = sum(r["rows"] for r in runs)
    plan = schedule([(r["run"], r["groups"], r["total"]) for r in runs], shards)
    spark = docs.sparkSession
    ends = spark.createDataFrame([(k, [sum(v[: i + 1]) for i in range(shards)]) for k, v in plan.items()] or [(-1, [0])], "run long, ends array<long>")
    slices = min(MOST_SLICES, rows // (SLICE * shards) + 16)
    ranked = _ranked(groups, "run", slices, same, "rank").join(F.broadcast(ends), "run")
    placed = written(ranked.select(*same, "copies", F.size(F.filter("ends", lambda e: e <= F.col("rank"))).alias("shard")))
    hot = F.col("copies") > rows * HOT
    by_hot = thin.join(F.broadcast(placed.filter(hot).drop("copies")), same, "left")
    done = by_hot.filter("shard IS NOT NULL")
    rest = by_hot.filter("shard IS NULL").drop("shard").join(placed.filter(~hot).drop("copies"), same)
    dealt = done.unionByName(rest)
    return _ranked(dealt, "shard", slices, ["row_key"], "slot").select("doc_id", "size", "text_crc32", F.col("shard").cast("int"), "slot", *["text"] * with_text)


def write_shards(docs: DataFrame, path: str, shards: int = 16) -> None:
    """Write documents as Parquet, a folder for each shard, in the order of slots within each file."""
    shard(docs, shards, with_text=True).repartition("shard", F.floor(F.col("slot") / SLICE)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
