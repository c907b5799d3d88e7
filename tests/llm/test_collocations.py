"""Collocations and shards against plain versions of themselves."""

import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import collocations, sharding
from loomgraph.llm.common import TO_LOWER

from .test_operators import AWKWARD, docs


def plain_collocations(rows, least, most_rows):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(TO_LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for d in range(1, 6):
                f[lang].update(tuple(words[i : i + d]) for i in range(len(words) - d + 1))
    out = []
    for lang, counts in f.items():
        kept = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        parts = defaultdict(int)
        for p, a in kept.items():
            for d in range(2, len(p)):
                for i in range(len(p) - d + 1):
                    parts[p[i : i + d]] = max(parts[p[i : i + d]], a)
        rows_ = []
        for p, a in kept.items():
            if parts[p] < a:
                score, _, l, r = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                rows_.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows_)[:most_rows], 1)]
    return sorted(out)


def some_texts(seed, n=60):
    rng = random.Random(seed)
    words = ["a", "b", "Of", "the", "é", "世界", "x y", "\x00", "it's"]
    ends = [" ", "  ", "\t", ". ", ",", "\n", "\r\n", "; "]
    return [(i, "".join(rng.choice(words[: rng.randint(1, 9)]) + rng.choice(ends[: rng.choice([1, 2, 8])]) for _ in range(rng.randint(0, 40))), rng.choice(["en", "de", None, "und", ""]), "s", 1) for i in range(n)]


@pytest.mark.parametrize("bits,shard,least,most", [(1 << 20, 1 << 20, 3, 2000), (64, 100, 3, 5), (1 << 20, 60, 1, 2000), (1 << 10, 40, 2, 3)])
def test_collocations(spark, bits, shard, least, most):
    rows = some_texts(bits + shard) + AWKWARD + AWKWARD[4:6]
    found = collocations.mine(docs(spark, rows, f=1, phrase="x", a=2, w=3), least, most, bits, shard).collect()
    assert sorted(map(tuple, found)) == plain_collocations(rows, least, most) and found


def test_collocations_of_nothing(spark):
    assert collocations.mine(docs(spark, [])).count() == 0
    assert collocations.mine(docs(spark, [(1, None, None, "s", 1), (2, " .. ", "en", "s", 1)])).count() == 0


def test_exact_scores_beyond_64_bits(spark):
    wide = spark.sql("SELECT CAST(1000000000000 AS decimal(20,0)) * CAST(1000 AS decimal(5,0)) * CAST(9000000000001 AS decimal(20,0)) AS x, CAST(3 AS decimal(20,0)) * CAST(700000000000 AS decimal(20,0)) AS y")
    assert wide.selectExpr("CAST(x AS decimal(38,0)) div CAST(y AS decimal(38,0)) AS q").first().q == 1000 * 10**12 * 9000000000001 // (3 * 700000000000)


def test_suffix_array_and_lcp():
    rng = np.random.default_rng(5)
    for n, depth in ((1, 2), (2, 5), (300, 5), (300, 2), (50, 1)):
        symbols = rng.integers(0, 3, n)
        order = collocations.suffix_array(symbols, depth)
        lcp, length = collocations.neighbours(symbols, order, depth)
        key = lambda i: symbols[i : i + depth].tolist()
        assert [key(i) for i in order] == sorted(key(i) for i in range(n))
        run = lambda i: next((j for j, x in enumerate(key(i)) if x == 0), len(key(i)))
        assert length.tolist() == [run(i) for i in order]
        for j in range(1, n):
            a, b = key(order[j - 1])[: run(order[j - 1])], key(order[j])[: run(order[j])]
            assert lcp[j] == next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))


def test_long_texts_are_cut_between_words():
    raw = ("word " * 1000 + "w" * 300 + " b\n" + "c " * 50).encode()
    found = list(collocations.parts(raw, 64))
    assert b"".join(t[:own] for t, own in found) == raw and all(t[own:].count(b" ") <= 8 for t, own in found)


# ---- shards


def plain_heap(sizes, shards):
    heap, out = [(0, s) for s in range(shards)], []
    for size in sizes:
        load, s = heapq.heappop(heap)
        out.append(s)
        heapq.heappush(heap, (load + size, s))
    return out, sorted((s, x) for x, s in heap)


@pytest.mark.parametrize("seed", range(5))
def test_runs_are_dealt_as_the_heap_does(seed):
    rng = random.Random(seed)
    shards = rng.choice([1, 2, 3, 16])
    runs = [(k, n, n * size) for k, (size, n) in enumerate((s, rng.choice([1, 1, 2, 7, 100])) for s in rng.sample(range(1, 500), 40))]
    plan = sharding.schedule(runs, shards)
    order = [(k, total // n) for k, n, total in sorted(runs, key=lambda r: -r[2] / r[1]) for _ in range(n)]
    want, loads = plain_heap([s for _, s in order], shards)
    counts = defaultdict(lambda: [0] * shards)
    for (k, _), s in zip(order, want):
        counts[k][s] += 1
    assert plan == dict(counts)
    assert [sum(plan[k][s] * total // n for k, n, total in runs) for s in range(shards)] == [x for _, x in loads]


def test_sizes_fall_into_runs(spark):
    sizes = [1, 2, 2047, 2048, 2049, 2050, 4095, 4096, 4097, 10**9, 2**40, 2**40 + 2**28, 2**40 + 2**30]
    rows = spark.createDataFrame([(s,) for s in sizes], "size long").withColumn("run", sharding.run_key(F.col("size"))).collect()
    runs = defaultdict(list)
    for r in rows:
        runs[r.run].append(r["size"])
    assert sorted(map(sorted, runs.values())) == [[1], [2], [2047], [2048, 2049], [2050], [4095], [4096, 4097], [10**9], [2**40, 2**40 + 2**28], [2**40 + 2**30]]
    assert all(max(v) - min(v) <= min(v) / 1024 for v in runs.values())


@pytest.mark.parametrize("hot,shards", [(sharding.HOT, 16), (0.2, 3)])
def test_shards(spark, monkeypatch, hot, shards):
    monkeypatch.setattr(sharding, "HOT", hot)
    rng = random.Random(shards)
    rows = AWKWARD + [(100 + i, "copy of all" if i % 3 == 0 else "word " * rng.randint(0, 900) + str(i % 50), "en", "s", 1) for i in range(400)]
    found = sharding.shard(docs(spark, rows, shard=1, size="x", run=2), shards, with_text=True).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert sorted((r.doc_id is not None, r.doc_id or 0, r["size"], r.text_crc32, r.text or "") for r in found) == sorted((d is not None, d or 0, size(t), zlib.crc32((t or "").encode()), t or "") for d, t, *_ in rows)
    slots, of, loads = defaultdict(list), defaultdict(set), Counter()
    for r in found:
        slots[r.shard].append(r.slot)
        of[r.text or ""].add(r.shard)
        loads[r.shard] += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and all(len(v) == 1 for v in of.values())
    groups = Counter()
    for _, t, *_ in rows:
        groups[t or ""] += size(t)
    best = plain_heap(sorted(groups.values(), reverse=True), shards)[1]
    assert max(loads.values()) <= max(x for _, x in best) * 1.01
    assert sharding.shard(docs(spark, [])).count() == 0


def test_shards_as_files(spark, tmp_path):
    sharding.write_shards(docs(spark), str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(AWKWARD) and {r.shard for r in back.select("shard").distinct().collect()} <= {0, 1, 2}
