"""Long, repetitive and broken inputs, ties, and whole queries against plain versions of themselves."""

import os
import random
import re
import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import collocations, common, decontamination, gif, jaccard_join, language_id, licenses, packing, prefix_counts, secret_scans, sharding, toxicity, url_filters
from loomgraph.llm.tokens import vocabulary

from .test_operators import SF, contaminated, docs, encode, lzw_encode, near_copies, plain_spans, words

LENGTH = 5_000_000


def quick(f, *args):
    began = time.process_time()
    out = f(*args)
    assert time.process_time() - began < 5
    return out


# ---- GIF


def plain_lzw(raw, bits, count):
    """One code after another, from one large number."""
    clear, value, at, width, table, before, out = 1 << bits, int.from_bytes(raw, "little"), 0, bits + 1, [], None, []
    while len(out) < count:
        code = value >> at & (1 << width) - 1
        at += width
        if code == clear:
            table, width, before = [[i] for i in range(clear)] + [None, None], bits + 1, None
            continue
        entry = table[code] if code < len(table) else [*before, before[0]]
        out += entry
        if before is not None and len(table) < 4096:
            table.append([*before, entry[0]])
        before = entry
        if len(table) == 1 << width and width < 12:
            width += 1
    return out


@pytest.mark.parametrize("bits", [2, 5, 8])
def test_lzw_encoder(bits):
    rng = random.Random(bits)
    for n in (0, 1, 2, 64, 5000, 30_000):
        for draw in (lambda: rng.randrange(1 << bits), lambda: rng.choice((0, 1)), lambda: 1):
            samples = bytes(draw() for _ in range(n))
            raw = gif.lzw_encode(samples, bits)
            assert plain_lzw(raw, bits, n) == list(samples) == gif.lzw_decode(raw, bits, n).tolist()
            assert n == 0 or raw == lzw_encode(samples, bits)


def test_stored_text_is_compressed_and_follows_the_table(spark, monkeypatch):
    seen = []
    segment = gif._segment
    monkeypatch.setattr(gif, "_segment", lambda codes, clear, most: seen.append(max(codes)) or segment(codes, clear, most))
    text = ("the same words again and again " * 400).encode()
    payload = text + bytes(-len(text) % 64)
    stored = gif.encode(payload)
    assert len(stored) < len(payload) / 3 and gif.read_back(stored)[0] == payload and max(seen) > 257
    rows = [(1, "a" * 200_000, "en", "s", 1), (2, "".join(random.Random(1).choices("abcdefgh ", k=2_500_000)), "en", "s", 1)]
    for r in gif.text_media(docs(spark, rows)).collect():
        text = dict((d, t) for d, t, *_ in rows)[r.doc_id].encode()
        payload = text + bytes(-len(text) % 64)
        counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256).reshape(16, 16).sum(1)
        assert bytes(r.payload) == payload and r.histogram == counts.tolist() and r.n_frames == -(-len(payload) // (64 * gif.MOST_ROWS)) and r.duration_ms == 100 * r.n_frames


def test_broken_images_are_error_rows(spark):
    rng = random.Random(7)
    good = gif.encode(bytes(rng.choices(range(256), k=640)))
    no_palette = good[:10] + b"\0" + good[11:13] + good[13 + 768 :]
    huge = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0xF7, 0, 0) + good[13:]
    broken = [no_palette, huge, good[:-5], b"GIF89a"]
    for _ in range(600):
        b = bytearray(good if rng.random() < 0.7 else good[: rng.randrange(len(good))])
        for _ in range(rng.randint(1, 6)):
            if b:
                b[rng.choice((rng.randrange(len(b)), min(len(b) - 1, rng.randrange(30) + 781), min(len(b) - 1, rng.randrange(14))))] = rng.randrange(256)
        broken.append(bytes(b))
    media = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(broken)] + [(0, None)], "frame_id long, gif binary")
    found = gif.frames(media, "frame_id", most_pixels=1 << 20).select("frame_id", "frame", "error").collect()
    assert {r.frame_id for r in found} == set(range(len(broken))) and all((r.frame is None) == (r.error is not None) for r in found)
    assert [r.error for r in found if r.frame_id == 1] == ["the canvas is too large"]
    with pytest.raises(ValueError):
        gif.frames(media.withColumnRenamed("frame_id", "red"), "red")


# ---- URL filters


@pytest.mark.parametrize("most", [url_filters.MOST_IN_EXPRESSION, 0])
def test_rules_of_equal_length(spark, monkeypatch, most):
    monkeypatch.setattr(url_filters, "MOST_IN_EXPRESSION", most)
    rules = [("allow", "x.co/"), ("block", "co/ab"), ("block", "y.org/a"), ("allow", "y.org/a"), ("block", "z.net/"), ("allow", "net/cc")]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(["http://x.co/ab", "http://q.co/ab", "http://y.org/a", "http://z.net/cc", "http://w.net/cc"])], "page_id long, url string, html string")
    got = {r.page_id: (r["rule"], r.verdict) for r in url_filters.filter_urls(pages, rules).collect()}
    assert got == {0: ("x.co/", "allow"), 1: ("co/ab", "block"), 2: ("y.org/a", "allow"), 3: ("z.net/", "block"), 4: ("net/cc", "allow")}


# ---- language ID, toxicity


def test_letters_by_category():
    assert not any(map(language_id.has_letter, ["½", "12 ²", "①", "_", "", "٣", "!?", "😀"]))
    assert all(map(language_id.has_letter, ["a", "1é", "世", "ª", "ǅ"]))


def test_code_lengths_in_pieces(spark, monkeypatch):
    rng = random.Random(3)
    train = [(i, " ".join(rng.choices(["ba", "komi", "tu"], k=20)), "aa", "s", 1) for i in range(30)] + [(100 + i, " ".join(rng.choices(["ção", "que", "né"], k=20)), "bb", "s", 1) for i in range(30)]
    scorer = language_id.Scorer(language_id.fit(docs(spark, train)))
    raws = [b"", "ção que ba".encode() * 30, b"x", b"", b"tu" * 11, b"zz\xff", b""]
    whole = scorer.code_lengths(raws)
    for piece in (1, 2, 7, 64):
        monkeypatch.setattr(language_id, "PIECE", piece)
        assert np.allclose(scorer.code_lengths(raws), whole)
    assert scorer.code_lengths([]).shape == (0, 2)
    monkeypatch.undo()
    quick(scorer.code_lengths, [b"komi " * (LENGTH // 5)])


def test_toxicity_of_long_texts():
    scorer = toxicity.Scorer(toxicity.Model({"idiot": 5.0, "stupid": 4.0}, {"nast": 2.0}))
    for text in ("x" * LENGTH, "word " * (LENGTH // 5), "idiot " * 50_000, "\n" * LENGTH):
        quick(scorer.features, text)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_toxicity(spark):
    from loomgraph.llm.queries import op6_toxicity

    sf = SF.replace("0.001", "0.1")
    if not os.path.isdir(sf):
        pytest.skip("no larger tables")
    labels = spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter("toxic IS NOT NULL")
    found = op6_toxicity(spark, sf).filter("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(int(r.toxic), r.predicted): r["count"] for r in found}
    hits = n.get((1, 1), 0)
    assert hits >= 0.9 * (hits + n.get((1, 0), 0)) and hits >= 0.95 * (hits + n.get((0, 1), 0))


# ---- Jaccard join


def least_of(rows, n, percent):
    """Smallest document that links reach, by all pairs."""
    sets = []
    for d, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(common.TO_LOWER))
        sets.append((d, {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()))
    up = {d: d for d, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: root(d) for d in up}


@pytest.mark.parametrize(("block", "n", "percent"), [(256, 5, 80), (3, 5, 80), (2, 3, 90), (4, 2, 65)])
def test_components_with_shared_passages(spark, monkeypatch, block, n, percent):
    """Groups of copies, some of which link through others alone, and passages that a third of all texts share."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = random.Random(block)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = near_copies(rng, 6, 25, [10, 30, 70, 150])
    rows += [(100_000 + i, f"{' '.join(f'u{i}x{j}' for j in range(rng.randint(3, 60)))} {passage}", "en", "s", 1) for i in range(60)]
    chain = [f"c{i}" for i in range(60)]
    for i in range(25):
        chain[2 * i % 60] = f"new{i}"
        rows.append((200_000 + i, " ".join(chain), "en", "s", 1))
    rng.shuffle(rows)
    found = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs(spark, rows), n, percent).collect()}
    assert found == least_of(rows, n, percent)


def test_frequencies(spark):
    ranks = jaccard_join.frequencies(docs(spark, [(i, f"a b c d u{i}", "en", "s", 1) for i in range(300)]).repartition(5), 3)
    one, two = jaccard_join._counters(jaccard_join.shingles("a b c d", 3))
    assert min(ranks[0][one].tolist() + ranks[1][two].tolist()) >= int(4 * np.log2(301)) and ranks.shape == (2, jaccard_join.COUNTERS)
    assert not jaccard_join.frequencies(docs(spark, []), 3).any()


# ---- secrets


def plain_novel(text, taken, novelty, reach, least, around):
    """Every whole run against every sensitive word and every span."""
    found = []
    for c in re.finditer(r"[A-Za-z0-9+/_=.-]{20,}", text):
        near = any(m.start() - reach <= c.end() and c.start() <= m.end() + reach for m in secret_scans._CONTEXT.finditer(text))
        if near and not any(a < c.end() and c.start() < b for a, _, b in taken):
            if novelty(text[max(0, c.start() - around) : c.start()], c[0], text[c.end() : c.end() + around]) >= least:
                found.append((c.start(), "novel", c.end()))
    return found


def test_novel_spans_equal_all_pairs():
    rng = random.Random(16)
    novelty = secret_scans.Novelty(secret_scans.identifiers())
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_"
    some = 0
    for _ in range(600):
        parts = ["secret", "token", " ", " = ", "the words between ", "password: ", "\n", "x" * 30, "é", "configuration_value_of_the_default"]
        text = "".join(rng.choice(parts) if rng.random() < 0.7 else "".join(rng.choices(signs, k=rng.randint(15, 60))) for _ in range(rng.randint(1, 14)))
        base = secret_scans.base_spans(text)
        assert base == plain_spans(text)
        want = plain_novel(text, base, novelty, 20, 0.75, 64)
        assert secret_scans.novel_spans(text, base, novelty, 20, 0.75, 64) == want, text
        some += len(want)
    assert some > 50


def test_secrets_in_long_texts():
    novelty = secret_scans.Novelty(secret_scans.identifiers())
    for text in ("token " * (LENGTH // 6), "token=abcdefgh " * (LENGTH // 15), "secret " + "a" * LENGTH, "x" * LENGTH, "secret: " * (LENGTH // 8)):
        base = quick(secret_scans.base_spans, text)
        quick(secret_scans.novel_spans, text, base, novelty, 80, 0.75, 256)


# ---- licenses


def test_half_a_template_twice_is_half_of_it():
    assert licenses.merge([("t", 0, 0, [0, 1]), ("t", 6, 6, [0, 1])], {"t": 10}, 4, 6, 0.6) == []
    (span,) = licenses.merge([("t", 0, 0, [0, 1]), ("t", 6, 6, [0, 1])], {"t": 10}, 4, 6, 0.5)
    assert span["share"] == 0.5


def plain_licenses(text, templates, phrases, k, drift, least):
    """Base columns by slices of words, and spans by comparing the words of all positions with all of the templates."""
    w = words(text)
    places = [(i, label) for phrase, label in phrases.items() for p in [phrase.split()] for i in range(len(w)) if w[i : i + len(p)] == p]
    spans = []
    for name, own in templates.items():
        t = words(own)
        hits = sorted((i - j, i, j) for i in range(len(w) - k + 1) for j in range(len(t) - k + 1) if w[i : i + k] == t[j : j + k])
        runs = []
        for d, i, j in hits:
            if runs and d == runs[-1][-1][0]:
                runs[-1].append((d, i, j))
                continue
            stretch = [x for x in hits if x[0] == d]
            begin = min(x[1] for x in stretch)
            if runs and d - runs[-1][-1][0] <= drift and min(x[1] for x in runs[-1]) - len(t) <= begin <= max(x[1] for x in runs[-1]) + k + len(t):
                runs[-1].append((d, i, j))
            else:
                runs.append([(d, i, j)])
        for run in runs:
            begin, end = min(x[1] for x in run), max(x[1] for x in run) + k
            share = len({j + x for _, _, j in run for x in range(k)}) / len(t)
            if share >= least and len({i + x for _, i, _ in run for x in range(k)}) / (end - begin) >= least:
                spans.append((name, begin, end, round(share, 9)))
    starts = [i for i, _ in places]
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), sorted({x for _, x in places}), sorted(spans)


def test_licenses_equal_plain_words(spark):
    rng = random.Random(17)
    templates = {"a:one": "p q r s t u v w x y z p q r", "a:two": "k l m n o", "b:one": "cc by p q r s t l m", "mit:line": "Released under the MIT License"}
    pool = [*"pqrstuvwxyzklmno", "cc", "by", "mit", "license", "other", "gnu general public license"]
    rows = []
    for i in range(250):
        parts = [rng.choice(list(templates.values())) if rng.random() < 0.4 else " ".join(rng.choices(pool, k=rng.randint(1, 8))) for _ in range(rng.randint(0, 6))]
        text = " ".join(parts).split(" ")
        for _ in range(rng.randint(0, 3)):
            text.insert(rng.randrange(len(text) + 1), rng.choice(pool).upper())
        rows.append((i, rng.choice((" ", ", ", "\n")).join(text), "en", "s", 1))
    rows += [(300, None, "en", "s", 1), (301, "p q r s t u v p q r s t u v", "en", "s", 1)]
    found = licenses.scan(docs(spark, rows, votes=1, at=2), templates, k=3, drift=2).collect()
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, sorted((s.template, s.start, s.end, round(s.share, 9)) for s in r.spans)) for r in found}
    want = {d: plain_licenses(t, templates, licenses.PHRASES, 3, 2, 0.6) for d, t, *_ in rows}
    assert got == want and sum(len(x[5]) for x in want.values()) > 50
    for r in found:
        labels = sorted({*r.base_labels, *(s.template.split(":")[0] for s in r.spans)})
        assert r.labels == labels and abs(r.score - max([0.5 * bool(r.base_labels), *(s.share for s in r.spans)])) < 1e-9


def test_licenses_in_long_texts():
    cut = {n: licenses.words(t) for n, t in licenses.TEMPLATES.items()}
    number = licenses.numbers(cut, 4)
    for text in ("cc by " * (LENGTH // 6), "license " * (LENGTH // 8), "x" * LENGTH):
        tokens = quick(licenses.words, text)
        quick(licenses.phrase_places, tokens, licenses.PHRASES)
        quick(licenses.rolling, tokens, 4, number)
    quick(licenses.merge, [("t", 50 * i, 50 * i, [0, 1]) for i in range(200_000)], {"t": 10}, 4, 6, 0.5)
    quick(licenses.merge, [("t", i, i, [0]) for i in range(200_000)], {"t": 4}, 4, 6, 0.5)
    with pytest.raises(ValueError):
        licenses.numbers({"t": [str(i).encode() for i in range(70_000)]}, 4)


# ---- decontamination


@pytest.mark.parametrize("most", [decontamination.MOST_IN_SET, 0])
def test_passage_of_many_items(spark, monkeypatch, most):
    passage = " ".join(f"w{i}" for i in range(30))
    items = [(i, f"{passage} own{i}") for i in range(120)] + [(500, "solo"), (501, "two words")]
    rows = [(i, f"before{i} {passage} after", "en", "s", 1) for i in range(40)] + [(100, "a solo here, two words there and two solo", "en", "s", 1), (101, "w0 w2 w1 w0 w1 w3", "en", "s", 1)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for sent in (common.MOST_SENT, 0):
        monkeypatch.setattr(common, "MOST_SENT", sent)
        found = decontamination.contamination(docs(spark, rows), benchmark, most_in_set=most).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in found) == contaminated(rows, items)


# ---- the pipeline


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_by_its_contract(spark):
    """All stages in plain Python; near copies share 80 % of their five-word shingles."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [r for r in rows if language_id.has_letter(r[1] or "")]  # no text there is beyond the language models
    least = least_of(rows, 5, 80)
    gone = {d for d, x in least.items() if d != x}
    rows = [r for r in rows if r[0] not in gone]
    dirty = {d for d, _, n, _ in contaminated(rows, items) if n}
    rows = [r for r in rows if str(r[0]) not in dirty]
    novelty = secret_scans.Novelty(secret_scans.identifiers())

    def redacted(text):
        out, upto, base = "", 0, plain_spans(text)
        for a, _, b in sorted(base + plain_novel(text, base, novelty, 80, 0.75, 256)):
            if a >= upto:
                out += text[upto:a] + "[SECRET]"
            upto = max(upto, b)
        return out + text[upto:]

    want = {d: len(encode(library, redacted(t))) + 1 for d, t, *_ in rows}
    got, places = {}, {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == want and gone and dirty
    for found in places.values():
        found.sort()
        assert [o for o, _ in found] == [sum(n for _, n in found[:i]) for i in range(len(found))] and sum(n for _, n in found) <= 2048
    assert len(places) <= sum(want.values()) / 2048 * 1.02 + 1


NAMES = ["my col", "a-b", "a.b", "a`b", "Extra", "extra", "row", "spans", "c0", "none", "é", "lang_pred"]


def test_columns_of_any_name(spark):
    """Operators and stages ignore further columns, or keep them as they are, whatever their names and types."""
    import corpus_pipeline

    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    base = docs(spark)
    nested = F.struct(F.lit(1).alias("x y"), F.lit("z").alias("p.q"))
    wild = base.select("*", *[(nested if i % 3 == 0 else F.lit(i)).alias(n) for i, n in enumerate(NAMES)])
    model = language_id.fit(base)
    labels = spark.createDataFrame([(1, 0, 1), (5, 1, 0)], "doc_id long, quality int, toxic int").withColumn("a.b", F.lit(1))
    count = base.count()
    for keeps in (
        secret_scans.scan(wild), language_id.identify(wild, model), secret_scans.redact(wild), corpus_pipeline.redact_secrets(spark, wild, SF)
    ):
        rows = keeps.collect()
        assert len(rows) == count and keeps.columns.count("a.b") == 1 and "my col" in keeps.columns and rows[0]["my col"]["x y"] == 1
    for drops in (
        language_id.accepted(wild, model), decontamination.remove_documents(wild, items), decontamination.remove_spans(wild, items), jaccard_join.one_of_each(wild),
    ):
        assert drops.columns == wild.columns
        drops.collect()
    packed = packing.pack(wild), prefix_counts.prefix_counts(wild), gif.text_media(wild), licenses.scan(wild), decontamination.contamination(wild, items), jaccard_join.jaccard_components(wild)
    for found in (*packed, toxicity.score(wild, toxicity.fit(wild, labels)), collocations.mine(wild, 2), sharding.shard(wild)):
        found.collect()
    pages = spark.createDataFrame([(1, "http://a.com/x", "<p>")], "page_id long, url string, html string").select("*", *[F.lit(i).alias(n) for i, n in enumerate(NAMES)])
    assert url_filters.filter_urls(pages, [("block", "com/")]).collect()[0].verdict == "block"
