"""Benchmark decontamination by a broadcast hash set of n-grams. DataFrame operations only.

An item's windows are its runs of `n` words, or all of it where it has fewer. Each document's windows are hashed and
looked up in the set of the windows' hashes, and every hit is verified by its words before it counts, in the same row:
no document is shuffled. A position is hashed in full only if its first two words begin a window. The set goes out
with the plan as long as it holds at most MOST_IN_SET windows; beyond that the documents' window hashes are joined
with it, without a shuffle as long as it can be broadcast, and the hits are verified against the written words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, aside, few, restored, written

#: Windows of the benchmark that the plan may carry (about 80 bytes each).
MOST_IN_SET = 50_000
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of A-Z lower-cased text: runs of 0-9, a-z and all characters beyond ASCII."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _BREAK), "")


def windows(benchmark: DataFrame, n: int) -> DataFrame:
    """(item_id, length, window, hash) of benchmark(item_id, text); window: its words joined by blanks."""
    own = benchmark.select("item_id", words(F.col("text")).alias("words")).filter(F.size("words") > 0).withColumn("length", F.least(F.size("words"), F.lit(n)))
    at = F.explode(F.sequence(F.lit(0), F.size("words") - F.col("length")))
    cut = own.withColumn("at", at).withColumn("cut", F.slice("words", F.col("at") + 1, F.col("length")))
    head = F.xxhash64(F.get("cut", F.lit(0)), F.get("cut", F.lit(1)))
    return cut.select("item_id", "length", F.array_join("cut", " ").alias("window"), F.xxhash64("cut").alias("hash"), head.alias("head")).distinct()


HITS = "array<struct<pos:int,len:int,window:string>>"


def _starts(length: int) -> str:
    """Positions of all windows of a length in the row's words."""
    return f"CASE WHEN size(words) >= {length} THEN sequence(0, size(words) - {length}) ELSE CAST(array() AS array<int>) END"


def _in_set(by_length: dict[int, list]) -> Column:
    """Verified hits of a row with words. The lists are literals, which Catalyst turns into hash sets."""
    parts = [f"CAST(array() AS {HITS})"]
    for length, some in sorted(by_length.items()):
        cut = f"slice(words, i + 1, {length})"
        hashes, heads = (",".join(f"{x}L" for x in sorted(own)) for own in ({w.hash for w in some}, {w.head for w in some}))
        texts = ",".join(f"'{x}'" for x in sorted({w.window for w in some}))  # words have no quotes and no backslashes
        # The first words alone are cheap to look at, and few positions pass.
        first = f"xxhash64(words[i], {'words[i + 1]' if length > 1 else 'CAST(NULL AS string)'}) IN ({heads})"
        at = f"filter({_starts(length)}, i -> {first} AND xxhash64({cut}) IN ({hashes}))"
        hits = f"transform({at}, i -> named_struct('pos', i, 'len', {length}, 'window', array_join({cut}, ' ')))"
        parts.append(f"filter({hits}, x -> x.window IN ({texts}))")
    return F.expr(f"concat({', '.join(parts)})")


def _joined(split: DataFrame, found: DataFrame, lengths: list[int]) -> DataFrame:
    """The same hits, from a join of window hashes: for sets that are too large for the plan."""
    kept = written(split)
    each = [f"transform({_starts(n)}, i -> named_struct('pos', i, 'len', {n}, 'hash', xxhash64(slice(words, i + 1, {n}))))" for n in lengths]
    rows = kept.select("row_key", F.expr(f"explode({each[0] if len(each) == 1 else f'concat({", ".join(each)})'})").alias("w")).select("row_key", "w.*")
    some = rows.join(few(found.select("hash", "window", F.col("length").alias("len")).distinct()), ["hash", "len"])
    by_row = some.groupBy("row_key").agg(F.collect_list(F.struct("pos", "len", "window")).alias("hits"))
    verified = "filter(hits, x -> array_join(slice(words, x.pos + 1, x.len), ' ') = x.window)"
    return kept.join(by_row, "row_key", "left").withColumn("hits", F.coalesce(F.expr(verified), F.expr(f"CAST(array() AS {HITS})")))


def matches(docs: DataFrame, benchmark: DataFrame, n: int = 10, most_in_set: int = MOST_IN_SET) -> tuple[DataFrame, DataFrame, bool]:
    """docs with row_key, words and hits (array of pos, len, window), the benchmark's windows, and whether these are
    few enough to be sent along."""
    found = written(windows(benchmark, n))
    split = docs.withColumn("row_key", F.monotonically_increasing_id()).withColumn("words", words(F.col("text")))
    sizes = {x.length: x.n for x in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # n rows at most
    if sum(sizes.values()) > most_in_set:
        return _joined(split, found, sorted(sizes)), found, False
    by_length: dict[int, list] = {}
    for x in found.select("length", "window", "hash", "head").distinct().collect():
        by_length.setdefault(x.length, []).append(x)
    return split.withColumn("hits", _in_set(by_length)), found, True


#: Distinct positions in a row's spans (array of pos, len, sorted): each span adds what lies beyond those before it.
_COVERED = """aggregate(spans, named_struct('upto', 0, 'n', 0), (a, s) -> named_struct(
    'upto', greatest(a.upto, s.pos + s.len), 'n', a.n + greatest(0, s.pos + s.len - greatest(a.upto, s.pos)))).n"""


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, most_in_set: int = MOST_IN_SET) -> DataFrame:
    """Report for each row of docs(doc_id, text) against benchmark(item_id, text).

    Returns doc_id, n_words, n_hit (words inside a window of an item), items (sorted array of item_ids as strings)
    and spans (array of pos, len in words). Null texts have no words, items without words no windows. Repeated
    rows stay and count once each; further columns are dropped; an empty table gives no rows.
    """
    rows, found, small = matches(docs.select("doc_id", "text"), benchmark, n, most_in_set)
    hit = rows.select("row_key", "doc_id", F.size("words").alias("n_words"), F.explode_outer("hits").alias("hit"))
    # A window's items are one list, so a hit is one row however many items share its passage.
    named = found.groupBy("window").agg(F.collect_set(F.col("item_id").cast("string")).alias("own"))
    joined = hit.withColumn("window", F.col("hit.window")).join(F.broadcast(named) if small else named, "window", "left")
    span = F.when(F.col("own").isNotNull(), F.struct(F.col("hit.pos").alias("pos"), F.col("hit.len").alias("len")))
    items = F.array_sort(F.array_distinct(F.flatten(F.collect_set("own"))))
    by_row = joined.groupBy("row_key", "doc_id", "n_words").agg(F.array_sort(F.collect_set(span)).alias("spans"), items.alias("items"))
    return by_row.select("doc_id", F.col("n_words").cast("long"), F.expr(_COVERED).cast("long").alias("n_hit"), "items", "spans")


def _settled(rows: DataFrame, *kept: str) -> DataFrame:
    """The same hits behind a generator: else a filter on them is pushed below the words, which are then split anew
    for each position."""
    return rows.select(*kept, F.explode(F.array("hits")).alias("hits"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10, most_in_set: int = MOST_IN_SET) -> DataFrame:
    """docs without the rows that hold a window of an item; all columns stay as they are."""
    rows, _, _ = matches(aside(docs), benchmark, n, most_in_set)
    return restored(_settled(rows, "row", "text").filter(F.size("hits") == 0), docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10, most_in_set: int = MOST_IN_SET) -> DataFrame:
    """docs with the words inside windows of items, and the separators before them, cut out of text."""
    rows, _, _ = matches(aside(docs), benchmark, n, most_in_set)
    parts = _settled(rows, "row", "text").withColumn("spans", F.expr("array_sort(transform(hits, h -> struct(h.pos, h.len)))")).withColumn("own", F.expr(f"regexp_extract_all(text, r'{_WORD}', 0)")).withColumn("gap", F.expr(f"split(text, r'{_WORD}')"))
    kept = "filter(sequence(0, size(own) - 1), i -> NOT exists(spans, s -> i >= s.pos AND i < s.pos + s.len))"
    cut = F.expr(f"concat(array_join(transform({kept}, i -> concat(gap[i], own[i])), ''), gap[size(own)])")
    return restored(parts, docs.columns, F.when(F.size("spans") > 0, cut).otherwise(F.col("text")))
