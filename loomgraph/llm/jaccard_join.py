"""Exact n-gram Jaccard join: a size-aware heavy-light join of shingle sets.

Texts become sets of word shingles (64-bit hashes). Equal sets are one class from the start. Two classes of s and t
shingles link if they share at least c(s, t) of them, the least overlap that the threshold allows.

Light sets enumerate fixed-size subsets: a set of s emits, for each size t that a partner may have, its subsets of
c(s, t) shingles. Sets that share one link, with no need to look further. Heavy sets have too many such subsets;
they scan inverted lists of single shingles. Linked sets share one of their first s - c + 1 shingles in any order that
is the same for all sets, so a set enters no more lists than that: as the smaller one of a pair those of a shorter
prefix, as the larger one those of a longer one. The order is by frequency, rare shingles first, so that passages
which many documents share come last and make no lists. Frequencies are counted over all documents, in a table of
fixed size (`frequencies`): what its counters share only changes the order, never the links. The size up to which
sets are light comes from both costs (`boundary`).

Lists are never turned into all their pairs. Lists with the same members are kept once. Members are compared by
parity sketches (a lower bound of how many shingles differ) in blocks of a bounded size, and only a spanning forest of
the pairs that may link leaves a task. First every class is compared within its longest list alone, so that edges are
no more than classes. Links, verified with the whole sets, join classes to components; lists whose members are in one
component by then are done. Of the others, one member of each component is compared next, as long as that finds
links. What is left are lists whose components may link through other members: all members outside of the
list's largest component are compared with the members of other components, block by block, and every pair that may
link is tested. So no link between different texts is lost, and what is written grows with the members, not with
their square.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, few, free, map_batches, slices, texts, written
from .components import connected_components, with_links

#: Members of a list that one task compares with one another.
BLOCK = 256
#: Counters in each of the two rows of the frequency table, and those in one part of it.
COUNTERS, PART = 1 << 20, 1 << 15
#: Slots of a sketch.
MOST_SLOTS = 1 << 16
#: Sizes of a heavy class: from its least size to this many times it.
_SPREAD = 4
_P1, _P2, _P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    h = (h ^ (h >> np.uint64(32))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


class _Hashes(dict):
    """64-bit hash of a word, kept for two hundred thousand words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


_hashes = _Hashes()


def _runs(text: str, n: int) -> np.ndarray:
    """Hashes of the runs of n words of A-Z lower-cased text, in order; of all words if there are fewer."""
    words = text.encode().lower().split()  # bytes: lower() and split() know ASCII alone
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    size = min(n, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for i in range(size):
        h = (h + w[i : i + len(h)]) * _P1
        h ^= h >> np.uint64(31)
    return _mix(h)


def shingles(text: str, n: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of n words."""
    return np.unique(_runs(text, n))


def _counters(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The counter of each hash in both rows of the frequency table."""
    return (h >> np.uint64(44)).astype(np.int64), (h >> np.uint64(20) & np.uint64(COUNTERS - 1)).astype(np.int64)


def frequencies(docs: DataFrame, n: int) -> np.ndarray:
    """How often shingles occur in all of docs: steps of a fourth root of two, in two rows of counters.

    The table has the same size for any corpus. A task counts its documents and sends parts of its table, which are
    added by part. With N shingles in all, those that occur much more often than the square root of N / COUNTERS
    stand out from what shares their counters.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, COUNTERS), np.int32)  # of one task
        for batch in slices(batches, most=4 << 20):
            h = np.concatenate([_runs(t, n) for t in texts(batch)])
            for row, at in zip(total, _counters(h)):
                row += np.bincount(at, minlength=COUNTERS).astype(np.int32)
        if total.any():
            yield of_parts(dict(enumerate(total.reshape(-1, PART))))

    def of_parts(parts: dict[int, np.ndarray]) -> pa.RecordBatch:
        packed = [zstandard.compress(p.astype("<i8").tobytes(), 1) for p in parts.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array(packed, pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(zstandard.decompress(packed), "<i8")
                sums[part] = sums[part] + own if part in sums else own
        if sums:
            yield of_parts(sums)

    kind = "part int, counts binary"
    counted = map_batches(docs.select("text"), count, kind, _hashes)
    out = np.zeros((2 * COUNTERS // PART, PART), np.int64)
    for row in map_batches(counted.repartition(len(out), "part"), add, kind).collect():
        out[row.part] = np.frombuffer(zstandard.decompress(row.counts), "<i8")
    return (4 * np.log2(1 + out.reshape(2, COUNTERS))).astype(np.uint8)


class Sizes:
    """What the threshold (in per cent) means for set sizes."""

    def __init__(self, percent: int):
        self.percent = percent

    def least_partner(self, s: int) -> int:
        return -(-s * self.percent // 100)

    def largest_partner(self, s: int) -> int:
        return s * 100 // self.percent

    def overlap(self, s: int, t: int) -> int:
        """Least number of shared shingles of linked sets."""
        return -(-self.percent * (s + t) // (100 + self.percent))

    def differ(self, s: int, t: int) -> int:
        """Most shingles that are in one of two linked sets alone."""
        return (100 - self.percent) * (s + t) // (100 + self.percent)

    @cache  # noqa: B019
    def light_rows(self, s: int) -> int:
        return sum(math.comb(s, s - self.overlap(s, t)) for t in range(self.least_partner(s), self.largest_partner(s) + 1) if (s, self.overlap(s, t)) != (t, s))

    def prefix(self, s: int, least: int) -> int:
        """Shingles of a set of s of which one is shared with any linked set of `least` to s, itself in its prefix."""
        return s - self.overlap(least, s) + 1

    @property
    @lru_cache(1)  # noqa: B019
    def boundary(self) -> int:
        """Sets of up to this size are light: their subsets cost no more rows than the heavy way costs in lists
        and in shingles that are fetched to verify a candidate."""
        s = 1
        while self.light_rows(s + 1) <= self.prefix(s + 1, self.least_partner(s + 1)) + s + 1:
            s += 1
        return s

    @property
    def heavy_from(self) -> int:
        """Light sets that may link with heavy ones are in the inverted lists too."""
        return self.least_partner(self.boundary + 1)

    @cache  # noqa: B019
    def classes(self, s: int) -> tuple[tuple[int, int], ...]:
        """(class, prefix) of a heavy set: that of its size, and all before it that partners may be in.

        Lists are kept by the smaller set's class, so that sets of far different sizes are in no list together."""
        low, number, least = self.heavy_from, 0, self.least_partner(s)
        out: tuple[tuple[int, int], ...] = ()
        while True:
            high = low * _SPREAD
            if least <= high:
                out = ((number, self.prefix(s, max(low, least))), *out)
            if s <= high:
                return out
            low, number = high + 1, number + 1


def heavy_signatures(h: np.ndarray, sizes: Sizes, ranks: np.ndarray) -> list[np.ndarray]:
    """The lists that a set enters: a hash for each shingle of its prefix, in each class. The lowest bit is set
    where the set may be the smaller one of a pair."""
    one, two = _counters(h)
    order = np.argsort(np.minimum(ranks[0][one], ranks[1][two]), kind="stable")  # ties by hash, as h is sorted
    out, own = [], sizes.prefix(len(h), len(h))
    for number, length in sizes.classes(len(h)):
        signature = _mix(h[order[:length]] + np.uint64(number) * _P3) & ~np.uint64(1)
        signature[:own] |= np.uint64(1)
        out.append(signature)
        own = 0
    return out


def light_signatures(h: np.ndarray, sizes: Sizes) -> tuple[list[int], list[int]]:
    """Hashes of fixed-size subsets: those for larger or equal partners, and those for smaller ones."""
    s = len(h)
    mixed = [int(x) for x in _mix(h + _P2)]
    total, mask = sum(mixed), (1 << 64) - 1
    own, over = [], []
    for t in range(sizes.least_partner(s), sizes.largest_partner(s) + 1):
        c = sizes.overlap(s, t)
        if c == s == t:  # only an equal set
            continue
        salt = (min(s, t) << 20 | max(s, t)) * 0x9E3779B97F4A7C15
        for left_out in combinations(mixed, s - c):
            (over if t < s else own).append((total - sum(left_out) ^ salt) * 0xC2B2AE3D27D4EB4F & mask)
    return own, over


def sketch(h: np.ndarray) -> bytes:
    """Parities of the shingles' counts in slots, a power of two of them: one for each shingle at least, and no more
    than MOST_SLOTS, beyond which the bound only gets weaker.

    Two sketches differ in no more slots than their sets do in shingles; halves of one, added, are a smaller one."""
    slots = min(MOST_SLOTS, max(64, 1 << (len(h) - 1).bit_length()))
    odd = np.bincount(((h >> np.uint64(8)) & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _signed(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def sketches(docs: DataFrame, n: int, sizes: Sizes, ranks: np.ndarray) -> DataFrame:
    """doc_id, n_shingles, a 128-bit fingerprint of the set, and, once for each set in a task, its signatures."""
    most_seen = 500_000
    sent = docs.sparkSession.sparkContext.broadcast(ranks)  # of a fixed size

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        rank = sent.value
        for batch in slices(batches, most=8 << 20):
            size, one, two, signatures, made = [], [], [], [], []
            for text in texts(batch):
                h = shingles(text, n)
                s = len(h)
                key = (int(_mix(h).sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(_mix(h ^ _P1), dtype=np.uint64)) if s else 0)
                size.append(s), one.append(key[0]), two.append(key[1])
                if not s or key in seen:
                    signatures.append(None), made.append(None)
                    continue
                if len(seen) >= most_seen:
                    seen.clear()
                seen.add(key)
                parts = [np.empty(0, np.uint64)]
                if s <= sizes.boundary:
                    own, over = (np.array(x, np.uint64) for x in light_signatures(h, sizes))
                    parts += [own | np.uint64(1), over & ~np.uint64(1)]
                if s >= sizes.heavy_from:
                    parts += heavy_signatures(h, sizes, rank)
                signatures.append(_signed(np.concatenate(parts))), made.append(sketch(h))
            arrays = [pa.array(size, pa.int64()), pa.array(_signed(np.array(one, np.uint64))), pa.array(_signed(np.array(two, np.uint64)))]
            arrays += [pa.array(signatures, pa.list_(pa.int64())), pa.array(made, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *arrays], ["doc_id", "n_shingles", "f1", "f2", "signatures", "sketch"])

    return map_batches(docs.select("doc_id", "text"), find, "doc_id long, n_shingles long, f1 long, f2 long, signatures array<long>, sketch binary", _hashes)


def _matrix(parts: list[bytes]) -> np.ndarray:
    """Sketches, folded to the smallest one's size, as rows of 64-bit words."""
    least = min(map(len, parts))
    out = np.empty((len(parts), least // 8), np.uint64)
    for i, p in enumerate(parts):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(p, np.uint64).reshape(-1, least // 8), axis=0)
    return out


def _near(rows: np.ndarray, n: np.ndarray, i: int, others: np.ndarray, percent: int) -> np.ndarray:
    """Those of others that may link with member i by sizes and sketches."""
    apart = np.bitwise_count(rows[others] ^ rows[i]).sum(1)
    s, t = np.minimum(n[others], n[i]), np.maximum(n[others], n[i])
    return others[(apart <= (100 - percent) * (s + t) // (100 + percent)) & (100 * s >= percent * t)]


def forest(parts: list[bytes], n: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph of members that may link. Members near the middle come first, so
    that most of the others hang on them directly."""
    rows = _matrix(parts)
    bits = np.unpackbits(np.ascontiguousarray(rows[:, :64]).view(np.uint8), axis=1, bitorder="little")
    middle = bits.mean(0) > 0.5
    order = np.argsort((bits != middle).sum(1), kind="stable")
    left = np.ones(len(n), bool)
    edges: list[tuple[int, int]] = []
    for root in order:
        if not left[root]:
            continue
        left[root] = False
        queue = [int(root)]
        while queue:
            i = queue.pop(0)
            others = np.flatnonzero(left)
            if not len(others):
                return edges
            for j in _near(rows, n, i, others, percent):
                edges.append((i, int(j)))
                left[j] = False
                queue.append(int(j))
    return edges


def cross_members(parts: list[bytes], n: np.ndarray, component: np.ndarray, asks: np.ndarray, percent: int) -> np.ndarray:
    """Members that may link with one of another component, of which one asks and the other does not."""
    rows = _matrix(parts)
    some = np.zeros(len(n), bool)
    for i in np.flatnonzero(asks):
        others = np.flatnonzero(~asks & (component != component[i]))
        near = _near(rows, n, i, others, percent) if len(others) else others
        some[near] = True
        some[i] = len(near) > 0
    return np.flatnonzero(some)


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows (sig, block, ...) of one block at a time: they are bounded, and sorted by it. Blocks of one row have none
    to compare."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(_values(c) for c in batch.columns)):
            if row[:2] != key:
                if len(rows) > 1:
                    yield rows
                key, rows = row[:2], []
            rows.append(row)
    if len(rows) > 1:
        yield rows


def _values(column: pa.Array) -> list:
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy()
    return [flat[i:j].copy() for i, j in zip(ends[:-1], ends[1:])]


def _by_sketches(members: DataFrame, percent: int) -> DataFrame:
    """The members of blocks (sig, block, f1, f2, component, asks, n_shingles, sketch) that may link across
    components. Rows, not pairs: a block gives no more than it has."""
    kind = "sig long, block long, f1 long, f2 long, component long, asks boolean"
    types = [pa.int64()] * 5 + [pa.bool_()]
    names = [c.split()[0] for c in kind.split(", ")]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocked(batches):
            columns = list(zip(*rows))
            kept = cross_members(list(columns[7]), np.array(columns[6]), np.array(columns[4]), np.array(columns[5]), percent)
            if len(kept):
                yield pa.RecordBatch.from_arrays([pa.array([c[i] for i in kept], t) for c, t in zip(columns, types)], names)

    dealt = members.select(*names, "n_shingles", "sketch").repartition("sig", "block").sortWithinPartitions("sig", "block")
    return map_batches(dealt, find, kind)


def _by_sets(members: DataFrame, percent: int) -> DataFrame:
    """Links (src, dst) between members of blocks (sig, block, component, asks, doc_id, members), from whole sets: one
    that asks gives one link at most to each other component of its block."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocked(batches):
            out = []
            asked = [r for r in rows if not r[3]]
            for _, _, own, asks, src, s in rows:
                done = {own}
                for _, _, other, _, dst, t in asked if asks else ():
                    if other in done or 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
                        continue
                    shared = len(np.intersect1d(s, t, assume_unique=True))
                    if 100 * shared >= percent * (len(s) + len(t) - shared):
                        done.add(other)
                        out.append((src, dst))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["src", "dst"])

    dealt = members.select("sig", "block", "component", "asks", "doc_id", "members").repartition("sig", "block").sortWithinPartitions("sig", "block")
    return map_batches(dealt, find, "src long, dst long")


def _by_block(members: DataFrame, percent: int) -> DataFrame:
    """Edges (a1, a2, b1, b2) of a forest of each block (sig, block, f1, f2, n_shingles, sketch)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocked(batches):
            found = forest([r[5] for r in rows], np.array([r[4] for r in rows]), percent)
            if found:
                ends = [sum(sorted((rows[i][2:4], rows[j][2:4])), ()) for i, j in found]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*ends)], ["a1", "a2", "b1", "b2"])

    kept = members.select("sig", "block", "f1", "f2", "n_shingles", "sketch")
    return map_batches(kept.repartition("sig", "block").sortWithinPartitions("sig", "block"), find, "a1 long, a2 long, b1 long, b2 long")


def _blocks(size: str) -> Column:
    return F.ceil(F.col(size) / BLOCK).cast("long")


def _dealt(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("f1"), blocks)


def _sets(ends: DataFrame, docs: DataFrame, reps: DataFrame, n: int) -> DataFrame:
    """(f1, f2, doc_id, members) of the classes ends(f1, f2): the smallest document and the whole set."""
    wanted = checkpoint(reps.join(ends, ["f1", "f2"], "left_semi").select("doc_id", "f1", "f2"))
    chosen = docs.select("doc_id", "text").join(few(wanted.select("doc_id").distinct(), wanted.count()), "doc_id", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=4 << 20):
            found = [shingles(t, n) for t in texts(batch)]
            one = [int(_mix(h).sum(dtype=np.uint64)) for h in found]
            two = [int(np.bitwise_xor.reduce(_mix(h ^ _P1), dtype=np.uint64)) if len(h) else 0 for h in found]
            keys = [pa.array(_signed(np.array(x, np.uint64))) for x in (one, two)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *keys, pa.array([_signed(h) for h in found], pa.list_(pa.int64()))], ["doc_id", "f1", "f2", "members"])

    # A doc_id that stands for several rows may bring other texts along; the fingerprint tells them apart.
    found = map_batches(chosen, sets, "doc_id long, f1 long, f2 long, members array<long>", _hashes)
    return written(found.join(wanted, ["doc_id", "f1", "f2"], "left_semi").dropDuplicates(["f1", "f2"]))


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, n: int, percent: int) -> DataFrame:
    """pairs with the classes' smallest documents (src, dst) and whether they link, from the whole sets."""
    some = checkpoint(pairs)
    whole = _sets(some.select(F.col("a1").alias("f1"), F.col("a2").alias("f2")).union(some.select("b1", "b2")).distinct(), docs, reps, n)
    a = whole.select(F.col("f1").alias("a1"), F.col("f2").alias("a2"), F.col("doc_id").alias("src"), F.col("members").alias("ma"))
    b = whole.select(F.col("f1").alias("b1"), F.col("f2").alias("b2"), F.col("doc_id").alias("dst"), F.col("members").alias("mb"))
    both = some.join(a, ["a1", "a2"]).join(b, ["b1", "b2"]).withColumn("shared", F.size(F.array_intersect("ma", "mb")))
    union = F.size("ma") + F.size("mb") - F.col("shared")
    return checkpoint(both.select("a1", "a2", "b1", "b2", "src", "dst", (100 * F.col("shared") >= percent * union).alias("linked")))


def _same_id(some: DataFrame, reps: DataFrame) -> DataFrame:
    """Links between the classes of a doc_id that stands for several texts."""
    several = some.groupBy("doc_id").agg(F.min("f1").alias("a"), F.max("f1").alias("b")).filter("a <> b").select(F.col("doc_id").alias("src"))
    texts_of = some.select(F.col("doc_id").alias("src"), "f1", "f2").join(several, "src", "left_semi")
    return texts_of.join(reps.withColumnRenamed("doc_id", "dst"), ["f1", "f2"]).select("src", "dst")


def _lists(kept: DataFrame) -> DataFrame:
    """(sig, members, f1) of all lists of two classes or more of which one may be the smaller; equal lists once."""
    each = kept.select("f1", F.explode("signatures").alias("s"))
    rows = each.select(F.expr("s & -2L").alias("sig"), "f1", F.expr("s & 1L").alias("own"))

    def shared() -> DataFrame:
        # These three combine before the shuffle, so a signature of very many classes is no more than a row of each task.
        found = rows.groupBy("sig").agg(F.min("f1").alias("a"), F.max("f1").alias("b"), F.max("own").alias("own"))
        return written(found.filter("a <> b AND own = 1").select("sig"))

    several = shared()
    free(kept.sparkSession)
    inside = written(rows.join(several.hint("merge"), "sig").select("sig", "f1").distinct())
    free(kept.sparkSession)
    sums = [F.bit_xor(F.xxhash64(F.lit(i), "f1")).alias(f"x{i}") for i in (1, 2)]
    once = written(inside.groupBy("sig").agg(F.count("*").alias("members"), *sums).groupBy("members", "x1", "x2").agg(F.min("sig").alias("sig")).select("sig", "members"))
    return written(inside.join(few(once), "sig"))


def _left(lists: DataFrame, label: DataFrame, marked: DataFrame) -> DataFrame | None:
    """Blocks in which the members of different components of a list meet; None if no list has two components.

    Most members of a list are in its largest component. The others ask these, and one another. One that asks
    a component in several lists, as odd copies do in all lists of their group, asks the whole component once,
    unless its parts in the lists are fewer members altogether.
    """
    labelled = lists.select("sig", "f1").join(label, "f1")
    per = labelled.groupBy("sig", "component").agg(F.count("*").alias("own"))
    open_ = per.groupBy("sig").agg(F.count("*").alias("components"), F.max("own").alias("own"), F.max_by("component", F.struct("own", "component")).alias("top"), F.sum("own").alias("members"))
    open_ = checkpoint(open_.filter("components > 1").withColumn("others", F.col("members") - F.col("own")).drop("members"))
    if open_.isEmpty():
        return None
    size = label.join(marked.select("f1", "f2"), ["f1", "f2"]).groupBy("component").agg(F.count("*").alias("size"))
    odd = checkpoint(labelled.join(few(open_), "sig").filter("component <> top"))
    asks = odd.select("f1", "f2", "component", "top").distinct()
    by_list = open_.groupBy("top").agg(F.sum(F.col("others") * F.col("own")).alias("by_list"))
    tops = asks.groupBy("top").agg(F.count("*").alias("asks")).join(by_list, "top").join(size.withColumnRenamed("component", "top"), "top")
    tops = checkpoint(tops.withColumn("whole", F.col("asks") * F.col("size") <= F.col("by_list")))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), _blocks(n) - 1))

    def meet(key: str, asking: DataFrame, n: str, asked: DataFrame, m: str) -> DataFrame:
        """Each block of the n that ask with each block of the m that are asked."""
        a = asking.withColumn("with", every(m)).withColumn("block", _dealt(_blocks(n)) * _blocks(m) + F.col("with")).withColumn("asks", F.lit(True))
        b = asked.withColumn("with", every(n)).withColumn("block", F.col("with") * _blocks(m) + _dealt(_blocks(m))).withColumn("asks", F.lit(False))
        kept = lambda df: df.select(F.col(key).alias("sig"), "block", "f1", "f2", "component", "asks")
        return kept(a).unionByName(kept(b))

    whole = tops.filter("whole").select("top", "asks", "size")
    once = meet("top", asks.join(whole, "top"), "asks", label.join(marked.select("f1", "f2"), ["f1", "f2"]).join(whole.withColumn("component", F.col("top")), "component"), "size")
    parts = tops.filter("NOT whole").select("top")
    mixed = odd.join(parts, "top", "left_semi")
    within = labelled.join(open_.join(parts, "top", "left_semi"), "sig").filter("component = top")
    among = odd.filter("components > 2")
    blocks = once.unionByName(meet("sig", mixed, "others", within, "own")).unionByName(meet("sig", among, "others", among, "others"))
    return blocks.join(marked, ["f1", "f2"])


def jaccard_components(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """Components of the links of all rows of docs(doc_id, text) whose sets of n-word shingles have a Jaccard
    similarity of `percent` per cent or more.

    Returns doc_id, n_shingles and component_id, the smallest doc_id that links reach. Null and empty texts, and
    those of white space, have no shingles and no links. Equal texts link; repeated rows stay; a doc_id on several
    rows links through each of them; rows without a doc_id link nothing; further columns are dropped; an empty table
    gives no rows. percent: 60 to 100.
    """
    if not 60 <= percent <= 100:
        raise ValueError("percent must be from 60 to 100")
    spark, sizes = docs.sparkSession, Sizes(percent)
    table = written(sketches(docs, n, sizes, frequencies(docs, n)))
    some = table.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = written(some.groupBy("f1", "f2").agg(F.min("doc_id").alias("doc_id")))
    kept = table.filter("sketch IS NOT NULL")
    lists = _lists(kept)
    free(spark)
    marks = kept.select("f1", "f2", "n_shingles", "sketch").dropDuplicates(["f1", "f2"])
    if lists.isEmpty():
        marked = marks.limit(0)
    else:
        marked = written(marks.join(lists.select("f1").distinct(), "f1", "left_semi"))
    own = lists.groupBy("f1").agg(F.max_by("sig", F.struct("members", "sig")).alias("sig"), F.max("members").alias("members"))
    first = marked.join(own, "f1").withColumn("block", _dealt(_blocks("members")))
    tested = _verified(_by_block(first, percent).distinct(), docs, reps, n, percent)
    found = connected_components(checkpoint(tested.filter("linked").select("src", "dst").unionByName(_same_id(some, reps))))
    free(spark)

    def tests(edges: DataFrame) -> DataFrame:
        return _verified(edges.distinct().join(tested.select("a1", "a2", "b1", "b2"), ["a1", "a2", "b1", "b2"], "left_anti"), docs, reps, n, percent)

    def label() -> DataFrame:
        return reps.join(found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select("f1", "f2", F.coalesce("component", "doc_id").alias("component"))

    longer = lists.filter(F.col("members") > BLOCK)
    while not longer.isEmpty():
        per = longer.join(label(), "f1").groupBy("sig", "component").agg(F.min(F.struct("f1", "f2")).alias("rep"))
        sums = [F.bit_xor(F.xxhash64(F.lit(i), "component")).alias(f"x{i}") for i in (1, 2)]
        several = per.groupBy("sig").agg(F.count("*").alias("components"), *sums).filter("components > 1")
        once = checkpoint(several.groupBy("components", "x1", "x2").agg(F.min("sig").alias("sig")).select("sig", "components"))
        block = per.join(few(once), "sig").select("sig", "rep.f1", "rep.f2", "components").join(marked, ["f1", "f2"]).withColumn("block", _dealt(_blocks("components")))
        more = tests(_by_block(block, percent))
        tested = tested.unionByName(more)
        new = more.filter("linked").select("src", "dst")
        if new.isEmpty():
            break
        found = with_links(found, new)
        free(spark)
    left = _left(lists, checkpoint(label()), marked)
    free(spark)
    if left is not None:
        near = written(_by_sketches(left, percent))
        free(spark)
        if not near.isEmpty():
            whole = _sets(near.select("f1", "f2").distinct(), docs, reps, n)
            more = checkpoint(_by_sets(near.join(whole, ["f1", "f2"]), percent).distinct())
            if not more.isEmpty():
                found = with_links(found, more)
    of_class = reps.join(found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select("f1", "f2", F.coalesce("component", "doc_id").alias("component"))
    return table.join(of_class, ["f1", "f2"], "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """docs without the rows whose component has a smaller doc_id; of rows with the same doc_id one stays, and rows
    without a doc_id all stay. All columns stay as they are."""
    found = checkpoint(jaccard_components(docs, n, percent).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("rows")))
    gone = found.filter("doc_id <> component_id").select("doc_id")
    several = found.filter("doc_id = component_id AND rows > 1").select("doc_id")
    n_gone, n_several = gone.count(), several.count()
    plain = docs.toDF(*[c if c == "doc_id" else f"c{i}" for i, c in enumerate(docs.columns)])  # names of any kind
    kept = plain.join(few(gone, n_gone), "doc_id", "left_anti")
    if n_several:
        single = kept.join(few(several, n_several), "doc_id", "left_anti")
        kept = single.unionByName(kept.join(few(several, n_several), "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return kept.select(*plain.columns).toDF(*docs.columns)
