"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

Each document's ids, with a closing id, are cut into pieces of at most `capacity` tokens. A sequence is filled
greedily: the longest unpacked piece, then again and again the longest one that fits the gap. Then its smallest
piece is replaced by two unpacked pieces, if two fit the expanded gap more tightly.

What the packer decides depends on lengths alone, so it works on counts by length (at most `capacity` numbers,
whatever the corpus' size): a sequence's lengths form a pattern, and the pattern is repeated while its lengths
last, which is what packing one sequence after another does. Pieces get a rank among those of their length from
counts by (length, bucket), and patterns own ranges of ranks. No task sees all pieces, nothing but the counts
reaches the driver, and the plan that is broadcast has at most some thousand ranges for any corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, slices, texts, written
from .tokens import ids, made, vocabulary

PIECES = "row_key long, doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int, library: str, ranks: str | None, closing_id: int, with_ids: bool) -> DataFrame:
    """Cut every document: all pieces but the first have `capacity` tokens."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ids(library, ranks)
        for batch in slices(batches):
            key, doc, piece, start, length, crc, kept = [], [], [], [], [], [], []
            keys, docs_ = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k, d, text in zip(keys, docs_, texts(batch)):
                tokens = encode(text)
                row = np.empty(len(tokens) + 1, "<u4")
                row[:-1], row[-1] = tokens, closing_id
                raw, n = row.tobytes(), len(row)
                first = (n - 1) % capacity + 1
                for i, end in enumerate(range(first, n + 1, capacity)):
                    begin = max(0, end - capacity) if i else 0
                    part = raw[4 * begin : 4 * end]
                    key.append(k), doc.append(d), piece.append(i), start.append(begin), length.append(end - begin)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        kept.append(part)
            columns = [pa.array(key, pa.int64()), pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["row_key", "doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(kept, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    keyed = docs.select(F.monotonically_increasing_id().alias("row_key"), "doc_id", "text")
    return map_batches(keyed, cut, PIECES + (", ids binary" if with_ids else ""), made)


class _Counts:
    """How many pieces of each length are unpacked, and the longest length up to a bound, in O(log)."""

    def __init__(self, counts: np.ndarray):
        self.n = counts
        self.present = np.flatnonzero(counts).tolist()

    def longest(self, most: int, taken: dict[int, int]) -> int:
        """The longest length <= most with a piece beyond those taken; 0 if none."""
        import bisect

        at = bisect.bisect_right(self.present, most) - 1
        while at >= 0 and self.n[self.present[at]] <= taken.get(self.present[at], 0):
            at -= 1
        return self.present[at] if at >= 0 else 0

    def take(self, pattern: dict[int, int], times: int) -> None:
        for length, uses in pattern.items():
            self.n[length] -= uses * times
            if not self.n[length]:
                self.present.remove(length)


def best_two_fit(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths of one sequence, how many sequences), from counts by length (index: length).

    Equal to packing sequence after sequence; a pattern is repeated as long as no length of it runs out.
    """
    left, plan = _Counts(counts.copy()), []
    while left.present:
        taken: dict[int, int] = {}
        lengths: list[int] = []
        gap = capacity
        while (x := left.longest(gap, taken)) > 0:
            lengths.append(x)
            taken[x] = taken.get(x, 0) + 1
            gap -= x
        if gap and len(lengths) > 1:
            small = lengths[-1]  # the greedy fill takes them in descending order
            room, best = gap + small, (small, 0, 0)
            a = left.longest(room - 1, taken)
            while 2 * a > best[0]:
                with_a = taken | {a: taken.get(a, 0) + 1}
                b = left.longest(min(room - a, a), with_a)
                if b and a + b > best[0]:
                    best = (a + b, a, b)
                    if a + b == room:
                        break
                a = left.longest(a - 1, taken) if a > 1 else 0
            if best[1]:
                lengths[-1:] = best[1:]
                taken[small] -= 1
                for x in best[1:]:
                    taken[x] = taken.get(x, 0) + 1
        taken = {k: v for k, v in taken.items() if v}
        times = int(min(left.n[k] // v for k, v in taken.items()))
        left.take(taken, times)
        plan.append((sorted(lengths, reverse=True), times))
    return plan


def _ranges(plan: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, pieces of the length in a sequence, first sequence, offset of the first of them)"""
    used: dict[int, int] = {}
    out, first = [], 0
    for lengths, times in plan:
        offset = 0
        for x in dict.fromkeys(lengths):
            uses = lengths.count(x)
            out.append((x, used.get(x, 0), uses * times, uses, first, offset))
            used[x] = used.get(x, 0) + uses * times
            offset += uses * x
        first += times
    return out


def pack(
    docs: DataFrame,
    capacity: int = 2048,
    library: str | None = None,
    ranks: str | None = None,
    closing_id: int = 0,
    buckets: int = 256,
    with_ids: bool = False,
) -> DataFrame:
    """Pack all rows of docs(doc_id, text) into sequences of at most `capacity` tokens.

    Returns for each piece doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with_ids the piece's
    ids (binary, little-endian unsigned 32 bits). library: the vocabulary for the tokenizers library (default:
    byte_bpe_50k.json); ranks: the same one for tiktoken, or None to use the first library alone.
    Null and empty texts are one piece of the closing id. Repeated rows and equal doc_ids are packed each on its
    own; further columns are ignored; an empty table gives no rows.
    """
    default = library is None
    library = library or vocabulary("byte_bpe_50k.json")
    ranks = vocabulary("byte_bpe_50k.tiktoken") if default and ranks is None else ranks
    cut = written(pieces(docs, capacity, library, ranks, closing_id, with_ids))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    full = F.col("length") == capacity
    # A full piece is a sequence of its own; the plan gives no ids below 0.
    alone = cut.filter(full).select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    part = cut.filter(~full).withColumn("bucket", F.pmod(F.xxhash64("row_key", "piece"), F.lit(buckets)))
    by_bucket = part.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = by_bucket.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n"))
    # At most capacity - 1 numbers reach the driver, whatever the corpus.
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in part.groupBy("length").agg(F.count("*").alias("n")).collect():
        counts[length] = n
    ranges = _ranges(best_two_fit(counts, capacity))
    spark = docs.sparkSession
    plan = spark.createDataFrame(ranges or [(0, 0, 0, 1, 0, 0)], "length long, first_rank long, n_ranks long, uses long, first_sequence long, first_offset long")
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row_key", "piece")) - 1
    ranked = part.select(*names, "row_key", "bucket").withColumn("local", rank).join(before.drop("n"), ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("local"))
    p = F.broadcast(plan.withColumnRenamed("length", "l"))
    at = F.col("rank") - F.col("first_rank")
    placed = ranked.join(p, (F.col("length") == F.col("l")) & (at >= 0) & (at < F.col("n_ranks")))
    placed = placed.select(
        *names,
        (F.col("first_sequence") + F.floor(at / F.col("uses"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + at % F.col("uses") * F.col("length")).cast("long").alias("offset"),
    )
    return placed.unionByName(alone)
