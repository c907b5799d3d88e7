"""Phrase collocations from word-id suffix arrays.

A shard is a batch of texts. Its words get ids by (lang, word), and the array of ids, with a break between pieces, is
sorted by suffixes: prefix doubling in numpy ranks them by 1, 2, 4 ... words until that is at least the longest phrase.
Neighbours in this order share a number of leading words, their LCP; a run of neighbours with an LCP of at least d is an
LCP interval, and its length is the count of a phrase of d words in the shard. Counts of all shards are merged by
(lang, phrase).

Most phrases are rare, and a phrase is no more frequent than its parts. So words are counted first, then, by hash alone,
pairs of frequent words, then all phrases whose pairs are frequent. What is frequent travels to the shards as a bitmap
of a fixed size: a rare part that shares its bit or hash with a frequent one is counted in vain, and no frequent one is
lost. So counts are exact at any size of the bitmap.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import few, map_batches, slices, written

LONGEST = 5
#: Language of documents without one.
NO_LANG = "und"
#: Bits of the map of frequent parts (8 MB), whatever the corpus.
BITS = 1 << 26
#: Bytes of text in a shard; a longer text is cut, each part looking LONGEST - 1 words ahead.
SHARD = 8 << 20
#: A hash is below 2**31, so that the product with FACTOR (below 2**20) fits a long in Spark's arithmetic, too.
FACTOR, RANGE = 1_000_003, 1 << 31
_SPACE, _END = 32, 10
#: Lower-cases A-Z; a character that ends a piece becomes a line feed, a tab a blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else _END if c in b".,;:!?\n\x0b\x0c\r" else _SPACE if c == 9 else c for c in range(256))


def _hash(before: Column, word: Column) -> Column:
    return (before * FACTOR + F.crc32(word)) % RANGE


def phrase_hash(lang: Column, phrase: Column) -> Column:
    """The hash of a phrase of a language, as Part.hashes() has it."""
    return F.aggregate(F.split(phrase, " "), F.crc32(lang) % RANGE, _hash)


def bitmap(hashes: DataFrame, bits: int) -> bytes:
    """A map of `bits` bits in which those of the numbers hashes(hash) are set. What reaches the driver is bits / 64
    numbers at most."""
    at = hashes.select((F.col("hash") % bits).alias("at"))
    rows = at.groupBy((F.col("at") / 64).cast("int").alias("i")).agg(F.expr("bit_or(shiftleft(1L, CAST(at % 64 AS INT)))").alias("v"))
    found = rows.toArrow()
    out = np.zeros(bits // 64, "<u8")
    out[found["i"].to_numpy()] = found["v"].to_numpy().view(np.uint64)
    return out.tobytes()


def parts(raw: bytes, most: int) -> Iterator[tuple[bytes, int]]:
    """Folded text in parts of about `most` bytes that end between words, and how many bytes of each are its own; what
    comes after these is the beginning of the next part, for phrases that reach into it."""
    begin, n = 0, len(raw)
    while n - begin > most:
        end = max(raw.rfind(b" ", begin, begin + most), raw.rfind(b"\n", begin, begin + most)) + 1
        if end <= begin:  # one word of that length
            found = [x for x in (raw.find(b" ", begin), raw.find(b"\n", begin)) if x >= 0]
            end = min(found) + 1 if found else n
        reach, words = end, 0
        while reach < n and words < LONGEST - 1 and raw[reach] != _END:
            if raw[reach] == _SPACE:
                reach += 1
                continue
            stops = [x for x in (raw.find(b" ", reach), raw.find(b"\n", reach)) if x >= 0]
            reach, words = min(stops) if stops else n, words + 1
        yield raw[begin:reach], end - begin
        begin = end
    yield raw[begin:], n - begin


class Part:
    """The words of one language in a shard.

    ids: dense word ids from 1, in order; own: whether phrases may begin at the word (the rest only continues them);
    joined: whether the next word continues the piece.
    """

    def __init__(self, lang: str, texts: list[tuple[bytes, int]]):
        self.lang = lang
        line = np.frombuffer(b"\n".join(t for t, _ in texts) + b"\n", np.uint8)
        end = line == _END
        inside = ~(end | (line == _SPACE))
        first = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
        size = np.cumsum(inside, dtype=np.int32)
        pieces = np.cumsum(end, dtype=np.int32)[first]
        offsets = np.append(size[first] - 1, size[-1] if len(size) else 0).astype(np.int32)
        packed = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(line[inside])])
        coded = packed.dictionary_encode()
        self.words: pa.Array = coded.dictionary
        self.ids = coded.indices.to_numpy().astype(np.int64) + 1
        self.joined = np.append(pieces[1:] == pieces[:-1], False)[: len(first)]
        self.own = np.ones(len(first), bool)
        at = 0
        for t, own in texts:
            if own < len(t):
                self.own[np.searchsorted(first, at + own) : np.searchsorted(first, at + len(t))] = False
            at += len(t) + 1
        self._crc: np.ndarray | None = None

    def hashes(self, n: int) -> np.ndarray:
        """Hashes of the n words from each place on."""
        if self._crc is None:
            self._crc = np.fromiter((zlib.crc32(w) for w in self.words.to_pylist()), np.int64, len(self.words))
        each = self._crc[self.ids - 1]
        h = np.full(max(0, len(each) - n + 1), zlib.crc32(self.lang.encode()) % RANGE, np.int64)
        for j in range(n):
            h = (h * FACTOR + each[j : j + len(h)]) % RANGE
        return h

    def words_alone(self) -> tuple[pa.Array, np.ndarray]:
        """The distinct words and their counts."""
        n = np.bincount(self.ids[self.own] - 1, minlength=len(self.words))
        return self.words.filter(pa.array(n > 0)), n[n > 0]

    def intervals(self, least: int, most: int, part: int, frequent: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(d, a place of each, count of each) of the phrases of d = `least` to `most` words all of whose parts of `part`
        words (one or two) have their bits in `frequent`."""
        known = np.zeros(len(self.ids), bool)
        h = self.hashes(part) % (len(frequent) * 8)
        known[: len(h)] = frequent[h >> 3] >> (h & 7).astype(np.uint8) & 1
        # The next word goes on with a run if the pair of both is one that may be frequent.
        bridge = self.joined & known & _next(known) if part == 1 else self.joined & known
        # A word is kept if a run of `least` words holds it.
        begins = bridge
        for _ in range(least - 2):
            begins = bridge & _next(begins)
        keep = begins.copy()
        for j in range(1, least):
            keep[j:] |= begins[:-j]
        bridge = bridge & keep & _next(keep)
        at = np.flatnonzero(keep)
        if not len(at):
            return
        # The array of suffixes: kept words, with a 0 where a run ends.
        goes_on = bridge[at]
        place = np.arange(len(at)) + np.concatenate([[0], np.cumsum(~goes_on)[:-1]])
        symbols, origin = np.zeros((2, int(place[-1]) + 2), np.int64)
        symbols[place], origin[place] = self.ids[at], at
        starts = np.zeros(len(symbols), bool)
        starts[place] = self.own[at]
        order = suffix_array(symbols, most)
        order = order[starts[order]]
        lcp, length = neighbours(symbols, order, most)
        for d in range(least, most + 1):
            first = np.flatnonzero((lcp < d) & (length >= d))
            if len(first):
                # An interval ends where the next one, or a shorter suffix, begins.
                bounds = np.flatnonzero(lcp < d)
                ends = np.append(bounds[1:], len(order))[np.searchsorted(bounds, first)]
                yield d, origin[order[first]], ends - first

    def phrases(self, at: np.ndarray, d: int) -> pa.Array:
        """The d words from each of some places on, joined by blanks."""
        words = [self.words.take(pa.array(self.ids[at + j] - 1)) for j in range(d)]
        return pc.binary_join_element_wise(*words, b" ")


def _next(flags: np.ndarray) -> np.ndarray:
    """The flag of the next word."""
    return np.append(flags[1:], False)


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of the suffixes' first `depth` symbols at least, by prefix doubling."""
    n = len(symbols)
    rank, k = symbols, 1
    order = np.argsort(rank) if depth < 2 else None
    while k < depth:
        after = np.zeros(n, np.int64)
        after[: max(0, n - k)] = rank[k:] + 1
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key)
        sorted_ = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(False, sorted_[1:] != sorted_[:-1]))
        k *= 2
    return order


def neighbours(symbols: np.ndarray, order: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix in order: the words it shares with the one before, and its words up to the run's end; both up to
    `depth`."""
    n = len(order)
    lcp, length = np.zeros(n, np.int8), np.zeros(n, np.int8)
    same, more = np.ones(n, bool), np.ones(n, bool)
    padded = np.append(symbols, np.zeros(depth, np.int64))
    for j in range(depth):
        here = padded[order + j]
        more &= here > 0
        length += more
        same[1:] &= here[1:] == here[:-1]
        same[:1] = False
        same &= more
        lcp += same
    return lcp, length


def _shards(batch: pa.RecordBatch, shard: int) -> Iterator[list[Part]]:
    """The texts of a batch by language, in shards."""
    held: dict[str, list[tuple[bytes, int]]] = {}
    size = 0
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        for part, own in parts((text or "").encode().translate(_FOLD), shard):
            held.setdefault(NO_LANG if lang is None else lang, []).append((part, own))
            size += len(part)
            if size >= shard:
                yield [Part(k, v) for k, v in held.items()]
                held, size = {}, 0
    if held:
        yield [Part(k, v) for k, v in held.items()]


def _over_shards(docs: DataFrame, found: Callable[[Part, np.ndarray | None], Iterator[pa.RecordBatch]], schema: str, shard: int, frequent: Broadcast | None = None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if frequent is None else np.frombuffer(frequent.value, np.uint8)
        for batch in slices(batches, most=shard):
            for held in _shards(batch, shard):
                for part in held:
                    if len(part.ids):
                        yield from found(part, bits)

    return map_batches(docs.select("lang", "text"), run, schema)


def _rows(lang: str, phrases: pa.Array, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(phrases), 1 << 18):
        some = phrases.slice(at, 1 << 18)
        yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(some), np.int32))), some.cast(pa.string()), pa.array(n[at : at + (1 << 18)].astype(np.int64))], ["lang", "phrase", "f"])


def _words(part: Part, _: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    yield from _rows(part.lang, pa.array([b""]), np.array([part.own.sum()]))
    yield from _rows(part.lang, *part.words_alone())


def _pairs(part: Part, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    hashes = part.hashes(2)
    for _, at, n in part.intervals(2, 2, 1, bits):
        yield pa.RecordBatch.from_arrays([pa.array(hashes[at]), pa.array(n.astype(np.int64))], ["hash", "f"])


def _phrases(part: Part, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    for d, at, n in part.intervals(2, LONGEST, 2, bits):
        yield from _rows(part.lang, part.phrases(at, d), n)


def frequent_phrases(docs: DataFrame, least_count: int = 100, bits: int = BITS, shard: int = SHARD) -> DataFrame:
    """(lang, phrase, f) of all phrases of one to LONGEST words with f >= least_count in docs(lang, text), and of each
    language's number of words as the count of the empty phrase."""
    sc = docs.sparkSession.sparkContext
    kept = F.col("f") >= least_count
    named = "lang string, phrase string, f long"
    words = _over_shards(docs, _words, named, shard).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    words = written(words.filter(kept | (F.col("phrase") == "")))
    known = sc.broadcast(bitmap(words.filter("phrase <> ''").filter(kept).select(phrase_hash(F.col("lang"), F.col("phrase")).alias("hash")), bits))
    # Pairs of frequent words are many, and most are rare: they are counted by hash, so that their words stay where they are.
    pairs = _over_shards(docs, _pairs, "hash long, f long", shard, known).groupBy("hash").agg(F.sum("f").alias("f"))
    known = sc.broadcast(bitmap(pairs.filter(kept).select("hash"), bits))
    longer = _over_shards(docs, _phrases, named, shard, known).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return words.unionByName(written(longer.filter(kept)))


def mine(docs: DataFrame, least_count: int = 100, most_rows: int = 2000, bits: int = BITS, shard: int = SHARD) -> DataFrame:
    """Each language's strongest collocations in all rows of docs(lang, text).

    Words are lower-cased in A-Z; phrases lie within pieces, which `.,;:!?` and line ends part. A candidate has two to
    five words and a = f(phrase) >= least_count (1 at least). l and r are the counts of its first k words and of the rest at the cut
    with the smallest floor(1000 a n / (l r)), the smallest k of equal ones; n is the language's number of words. A
    candidate inside a longer one with the same count goes. Returns lang, rank, phrase, a, l, r, n, score for the first
    `most_rows` of each language by score and a, both descending, and phrase.

    A null text is an empty one, a null language `und`; repeated rows count each; further columns are ignored; an empty
    table, and a language without candidates, give no rows.
    """
    found = frequent_phrases(docs, max(1, least_count), bits, shard)
    n = found.filter("phrase = ''").select("lang", F.col("f").alias("n"))
    counts = found.filter("phrase <> ''")
    words = F.split("phrase", " ")
    candidates = counts.select("lang", "phrase", F.col("f").alias("a"), words.alias("w")).filter(F.size("w") > 1)
    each = candidates.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    join = lambda a, b: F.array_join(F.slice("w", a, b), " ")
    cuts = each.select("lang", "phrase", "a", "k", join(F.lit(1), F.col("k")).alias("head"), join(F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
    of = lambda part, name: counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
    cut = cuts.join(of("head", "l"), ["lang", "head"]).join(of("rest", "r"), ["lang", "rest"]).join(few(n), "lang")
    # Decimals of 38 digits and their whole quotient are exact.
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    scored = cut.withColumns({"over": (wide("a") * F.lit(1000).cast("decimal(5,0)") * wide("n")).cast("decimal(38,0)"), "under": (wide("l") * wide("r")).cast("decimal(38,0)")})
    scored = scored.withColumn("score", F.expr("over div under"))
    best = scored.groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", "n", "score"), F.struct("score", "k")).alias("s")).select("lang", "phrase", "s.*")
    # Parts of a longer candidate, with the greatest count of one that they lie in.
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda d: F.transform(F.sequence(F.lit(1), F.size("w") - d + 1), lambda i: F.array_join(F.slice("w", i, d), " "))))
    inside = candidates.filter(F.size("w") > 2).select("lang", "a", F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    free = best.join(inside, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") < F.col("a"))).drop("longer")
    # First within slices of a language, then among what is left: no task ranks a whole language.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    cut_ = free.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    near = cut_.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).filter(F.col("rank") <= most_rows)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return near.withColumn("rank", rank).filter(F.col("rank") <= most_rows).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
