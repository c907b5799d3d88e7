"""Small cases of the graph engine, and its order-dependent parts against plain Python."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph import schemas
from loomgraph.functions import properties, similarity, text
from loomgraph.operators import extraction, loading, resolution, retrieval, windows
from loomgraph.operators.evidence import NOTHING, Evidence
from loomgraph.operators.iteration import numbered, running_sum
from loomgraph.plans import agent, build, chat
from loomgraph.plans.guard import NotReadOnly, check
from loomgraph.plans.patterns import Match, shortest_path, shortest_paths
from loomgraph.plans.session import GraphSession
from loomgraph.sources import documents, filings
from loomgraph.streaming import incremental


def one(spark, column, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"{n} string" for n in "abcd"[: len(values)]))
    return df.select(column.alias("x")).first().x


def test_text(spark):
    assert one(spark, text.slugify(F.col("a")), " Form 20-F (2025)! ") == "form_20_f_2025"
    assert one(spark, text.strip(F.col("a")), " \t x \n") == "x"
    assert one(spark, text.token_sort(F.col("a")), "Infosys  LIMITED") == "infosys limited"
    cases = {("infosys", "infosys limited"): 63.64, ("fiscal 2024", "fiscal 2025"): 90.91, ("q1 fy 2024", "q2 fy 2024"): 90.0, ("fy 2024", "fy 2025"): 85.71, ("", ""): 100.0, ("a", ""): 0.0}
    for (a, b), score in cases.items():
        assert round(one(spark, text.indel_score(F.col("a"), F.col("b")), a, b), 2) == score
    money = {k: one(spark, c, "it was $2.45 billion then") for k, c in text.money(F.col("a")).items()}
    assert money == {"amount": "2450", "currency": "USD", "unit": "M"}
    assert one(spark, text.money(F.col("a"))["amount"], "nothing") is None


def test_clean_properties(spark):
    bag = {"n": None, "s": "t", "d": {"x": 1, "y": None, "z": {"q": 1}, "l": [1]}, "l": [1, "a", 2.5, True], "m": [1, None], "o": [{"k": 1}], "e": []}
    df = spark.createDataFrame([(json.dumps(bag),)], "j string").select(properties.parse(F.col("j")).alias("p")).select(F.to_json(properties.clean("p")).alias("x"))
    got = json.loads(df.first().x)
    assert {k: got[k] for k in ("s", "d_x", "l", "e")} == {"s": "t", "d_x": 1, "l": [1, "a", 2.5, True], "e": []}
    assert json.loads(got["m"]) == [1, None] and json.loads(got["o"]) == [{"k": 1}]
    assert set(got) == {"s", "d_x", "l", "m", "o", "e"}


def test_windows(spark):
    counts = spark.createDataFrame([(str(n), n) for n in range(8)], "document_id string, n_pages int")
    got = {}
    for r in windows.build(counts).orderBy("window_idx").collect():
        got.setdefault(int(r.document_id), []).append((r.start_idx, r.end_idx))
    assert got == {1: [(0, 1)], 2: [(0, 2)], 3: [(0, 3)], 4: [(0, 3), (2, 4)], 5: [(0, 3), (2, 5)], 6: [(0, 3), (2, 5), (4, 6)], 7: [(0, 3), (2, 5), (4, 7)]}
    with pytest.raises(ValueError):
        windows.build(counts, 2, 3)
    blocks = spark.createDataFrame([("d", 0, 1, 0, "text", 0, "  "), ("d", 1, 2, 0, "text", 0, " x\t"), ("d", 1, 2, 1, "text", 1, "y"), ("e", 0, 1, 0, "text", 0, "")], documents.BLOCKS)
    text_of = {r.document_id: (r.page_range, r.page_content) for r in windows.texts(blocks).collect()}
    assert text_of == {"d": ("1-2", "[Page 2]\nx\ny"), "e": ("1-1", windows.EMPTY)}


def test_filings(spark, tmp_path):
    for p in ("Acme Inc/2024/Form 10-K.pdf", "Acme Inc/2023/Form 10-K.PDF", "acme inc/x24/a.pdf", "Zed/2024/notes.txt", "Zed/2024/deep/a.pdf"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"x")
    got = [(r.filing_ord, r.year, r.document_id) for r in filings.discover(spark, str(tmp_path)).orderBy("filing_ord").collect()]
    assert got == [(1, "2023", "acme_inc_form_10_k"), (2, "2024", "acme_inc_form_10_k")]
    assert filings.discover(spark, str(tmp_path), " ACME INC ").count() == 2
    assert filings.discover(spark, str(tmp_path), "other").count() == 0


def fold(records, least=88):
    """Sequential resolution in plain Python."""

    def score(a, b):
        row = [0] * (len(b) + 1)
        for c in a:
            before, row = row, [0]
            for j, d in enumerate(b):
                row.append(before[j] + 1 if c == d else max(before[j + 1], row[j]))
        return 200 * row[-1] / (len(a) + len(b)) if a or b else 100

    leaders, out = [], []
    for key, kind, name in records:
        tokens = " ".join(sorted(name.lower().split()))
        hit = next((x[0] for x in leaders if x[0] == key), None) or next((x[0] for x in leaders if x[1] == kind and score(x[2], tokens) >= least), None)
        if hit is None:
            leaders.append((key, kind, tokens))
        out.append(hit or key)
    return out


def test_resolution_equals_a_fold(spark):
    rng = random.Random(7)
    stems = ["infosys limited", "limited infosys", "infosys ltd", "fiscal 2024", "fiscal 2025", "fiscal 2026", "metric revenue q1", "metric revenue q2", "metric revenue qq2", "a", "ab", "x y z"]
    for _ in range(3):
        records = [(f"id{rng.randrange(12)}", rng.choice(["A", "B"]), rng.choice(stems)) for _ in range(40)]
        df = spark.createDataFrame([("d", 0, i, k, t, n) for i, (k, t, n) in enumerate(records)], "document_id string, doc_ord long, seq long, id string, type string, name string")
        got = [r.canonical_id for r in resolution.assign(df).orderBy("seq").collect()]
        assert got == fold(records)


@pytest.mark.parametrize("first,local", [(2, 0), (5, 3), (7, 1000), (1000, 4)])
def test_resolution_in_parts_and_rounds_equals_a_fold(spark, first, local):
    """Parts, rounds of all keys and the rest in one task make the same decisions as one record after another."""
    rng = random.Random(first + local)
    names = [f"Customer#{rng.randrange(400):06d}" for _ in range(25)] + ["", "é" * 70, "é" * 69 + "x", "a b", "B A", "world wide steel", "wide world steels"]
    records = [(f"id{rng.randrange(30)}", rng.choice(["A", "B"]), rng.choice(names)) for _ in range(90)]
    df = spark.createDataFrame([("d", 0, 10 * i, k, t, n) for i, (k, t, n) in enumerate(records)], "document_id string, doc_ord long, seq long, id string, type string, name string")
    got = [r.canonical_id for r in resolution.assign(df, first=first, local=local).orderBy("seq").collect()]
    assert got == fold(records)


def test_only_similar_names_are_candidates(spark, monkeypatch):
    rng = random.Random(5)
    hexes = [f"{rng.getrandbits(128):032x}" for _ in range(300)]
    made = {"numbered": [f"customer#{i:09d}" for i in range(0, 3000, 7)], "hex": hexes + [h[:9] + h[11:] + "xx" for h in hexes[:40]]}
    words = ["acme", "acmes", "steel", "steal", "limited", "limitd", "of", "a", "north", "nörth", "group"]
    made["mixed"] = sorted({" ".join(rng.choices(words, k=rng.randint(0, 5))) for _ in range(250)} | {"", "x", "xy"})
    names = spark.createDataFrame([(t, n) for t, ns in made.items() for n in ns], "type string, name string")
    true = {(t, *sorted((x, y))) for t, ns in made.items() for i, x in enumerate(ns) for y, score in zip(ns[:i], similarity.scores([x] * i, ns[:i])) if score >= 88}
    found = resolution.similar_names(names).collect()
    assert len(found) == len(true) and {(r.type, r.a, r.b) for r in found} == true
    monkeypatch.setattr(resolution, "scored", lambda pairs, least: pairs)  # what would be compared
    asked = resolution.similar_names(names).collect()
    near = lambda rows, t: sum(r.type == t for r in rows)
    assert near(asked, "numbered") == near(found, "numbered") and near(asked, "hex") < 100


def test_numbered_types_are_compared_by_id_in_strict_mode(spark):
    rows = [("d", 0, i, f"m{i}", kind, f"fiscal year {2000 + i}") for i, kind in enumerate(["Period"] * 3 + ["Metric"] * 3)]
    df = spark.createDataFrame(rows, "document_id string, doc_ord long, seq long, id string, type string, name string")
    for local in (0, 100):
        got = [r.canonical_id for r in resolution.assign(df, strict=True, local=local).orderBy("seq").collect()]
        assert got == ["m0", "m1", "m2", "m3", "m3", "m3"]


def test_common_subsequences_of_any_length():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcé世\0😀") for _ in range(rng.choice([0, 1, 5, 30, 63, 64, 65, 200])))
    a, b = [word() for _ in range(150)], [word() for _ in range(150)]

    def plain(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            before, row = row, [0]
            for j, d in enumerate(y):
                row.append(before[j] + 1 if c == d else max(before[j + 1], row[j]))
        return row[-1]

    assert similarity.common_subsequences(a, b).tolist() == [plain(x, y) for x, y in zip(a, b)]
    many = similarity.Names(b)
    for x in a[:40]:
        assert many.scores(x, np.arange(150)).tolist() == pytest.approx(similarity.scores([x] * 150, b).tolist())
    assert similarity.common_subsequences([], []).tolist() == []


RESPONSES = [
    (0, '{"entities":[{"id":"company_a","type":"Company","properties":{"name":"A","x":1},"source":{"page_num":1,"section":"s"}},{"id":"odd","type":"Alien","properties":{}},{"type":"Company","properties":{}}],"relationships":[{"source_id":"company_a","target_id":"geography_i","type":"OPERATES_IN","properties":{"filing_year":2024}}]}'),
    (1, "not json"),
    (2, None),
    (3, '{"entities":[{"id":"geography_i","type":"Geography","properties":{"name":"I"}},{"id":"company_a","type":"Company","properties":{"x":null,"y":"2"}}],"relationships":[{"source_id":"company_a","target_id":"geography_i","type":"OPERATES_IN","properties":{"filing_year":"2024"}},{"source_id":"company_a","target_id":"geography_i","type":"OPERATES_IN","properties":{"filing_year":2024}},{"source_id":"company_a","target_id":"nowhere","type":"OPERATES_IN"}]}'),
]


def test_build_from_responses(spark):
    found = spark.createDataFrame([("d", i, "1-3", r) for i, r in RESPONSES], "document_id string, window_idx int, page_range string, response string")
    entities, relationships, errors = extraction.parsed(found)
    assert sorted(r.message for r in errors.collect()) == ["an entity has no id", "the extractor failed", "unreadable JSON: not json"]
    built = build.graph_of(entities, relationships, errors)
    nodes = {r.entity_id: (r.entity_type, r.name, json.loads(r.p)) for r in built.nodes.select("entity_id", "entity_type", "name", F.to_json("properties").alias("p")).collect()}
    assert nodes == {"company_a": ("Company", "A", {"name": "A", "y": "2"}), "geography_i": ("Geography", "I", {"name": "I"})}
    edges = built.edges.select("src", "type", "tgt", F.to_json("properties").alias("p")).collect()
    assert [(r.src, r.type, r.tgt, json.loads(r.p)) for r in edges] == [("company_a", "OPERATES_IN", "geography_i", {"filing_year": "2024"})]
    assert built.edge_history.count() == 2
    done = built.summary.first()
    assert (done.entities_resolved, done.attempted, done.written) == (2, 3, 2)


def test_late_windows_keep_their_order(spark):
    bag = '{"entities":[{"id":"a","type":"Company","properties":{"rank":%d}}],"relationships":[{"source_id":"a","target_id":"a","type":"REPORTS","properties":{}}]}'
    rows = [("d", 3, w, "1-3", bag % w) for w in (2047, 2048, 5000, 900_000)]
    entities, relationships, _ = extraction.parsed(spark.createDataFrame(rows, "document_id string, doc_ord int, window_idx int, page_range string, response string"))
    merged = extraction.merge_entities(entities).select("seq", F.expr("variant_get(properties['rank'], '$', 'bigint')").alias("rank")).collect()
    assert [tuple(r) for r in merged] == [(3 * 2**40 + 2047 * 2**20, 900_000)]
    assert [r.seq for r in extraction.dedup_relationships(relationships).collect()] == [3 * 2**40 + 2047 * 2**20]


def test_responses_are_whole_objects(spark):
    good = ['{}', ' {"entities":[]}\n', '{"a":[1,{"b":"}"}],"b":"] {"}']
    bad = ["4537 words", "4537", "[{}]", '"x"', "", " ", "{} words", "{}]", "{}}", "{},{}", '{},"a":{}', "{}],[{}", '{"a":1} {"a":2}', "{}],\"x\":[{}", "{", "null", None]
    assert [one(spark, properties.is_object(F.col("a")), x) for x in good] == [True] * len(good)
    assert [one(spark, properties.is_object(F.col("a")), x) for x in bad] == [False] * len(bad)
    found = spark.createDataFrame([("d", 0, "1-3", "4537 words"), ("d", 1, "3-5", "{} words")], "document_id string, window_idx int, page_range string, response string")
    errors = extraction.parsed(found)[2].select("pages", "message").collect()
    assert sorted(map(tuple, errors)) == [("1-3", "unreadable JSON: 4537 words"), ("3-5", "unreadable JSON: {} words")]


def test_extractor_sees_known_ids_in_order(spark):
    rows = [("d", 0, 1, 0, "text", 0, "Acme operates in India"), ("d", 1, 2, 0, "text", 0, "x"), ("d", 2, 3, 0, "text", 0, "y"), ("d", 3, 4, 0, "text", 0, "Acme operates in India")]
    answers = extraction.responses(windows.texts(spark.createDataFrame(rows, documents.BLOCKS)), extraction.NameExtractor()).orderBy("window_idx").collect()
    assert [len(json.loads(r.response)["entities"]) for r in answers] == [2, 0]
    built = build.build(spark.createDataFrame(rows, documents.BLOCKS), extraction.NameExtractor())
    assert {r.entity_id for r in built.nodes.collect()} == {"company_acme", "geography_india"} and built.edges.count() == 1


def test_positions_and_running_sums(spark):
    df = spark.createDataFrame([(f"d{i % 97:03}", i) for i in range(500)], "k string, i long").repartition(7)
    got = {r.k: r.n for r in numbered(df, "k", "n").collect()}
    assert got == {f"d{i:03}": i for i in range(97)}
    sums = [r.s for r in running_sum(df, "i", "i", "s", bucket=30).orderBy("i").collect()]
    assert sums == [i * (i + 1) // 2 for i in range(500)]


def test_snapshot_layout(spark, tmp_path):
    nodes = spark.createDataFrame([("b", "T", ["T"], "Bee"), ("a", "T", ["T"], "ay"), ("c", "U", ["U"], None)], "entity_id string, entity_type string, labels array<string>, name string")
    edges = spark.createDataFrame([("a", "R", "b")], "src string, type string, tgt string")
    loading.write_snapshot(nodes, edges, str(tmp_path / "s"))
    again, links = loading.read_snapshot(spark, str(tmp_path / "s"))
    assert [r.entity_id for r in retrieval.search(again, "BE").collect()] == ["b"] and links.count() == 1
    assert "StringContains(name_lc,be)" in retrieval.search(again, "BE", limit=None)._jdf.queryExecution().executedPlan().toString()


def test_lookups_read_the_row_groups_of_their_value(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    rows = spark.range(4000).selectExpr(
        "concat('n', id) AS entity_id", "if(id % 2 = 0, 'Period', 'Company') AS entity_type", "array('x') AS labels", "if(id = 7, NULL, concat('Name ', id)) AS name",
        "from_json(CASE id % 5 WHEN 0 THEN '{}' WHEN 1 THEN NULL ELSE to_json(named_struct('fiscal_year', if(id % 3 = 0, concat('FY', 1900 + id % 100), string(1900 + id % 100)))) END, 'map<string,variant>') AS properties",
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files, as a large graph has
    try:
        loading.write_snapshot(rows, spark.createDataFrame([("a", "R", "b")], "src string, type string, tgt string"), str(tmp_path / "s"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    nodes, _ = loading.read_snapshot(spark, str(tmp_path / "s"))
    for kind, value in (("Period", "1942"), ("Period", "fy1942"), ("Company", "NAME 42"), ("Company", "name 43"), ("Period", "name 42"), ("Period", "absent")):
        here = sorted(r.entity_id for r in loading.lookup(nodes, kind, value).collect())
        assert here == sorted(r.entity_id for r in loading.lookup(rows, kind, value).collect())
        assert bool(here) == ((kind, value) not in (("Period", "name 42"), ("Period", "absent"), ("Company", "NAME 42")))
    plan = loading.lookup(nodes, "Period", "1942")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lookup,1942)" in plan and "(entity_type#" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    files = glob.glob(str(tmp_path / "s/nodes/*/*.parquet"))
    held = []
    for f in files:
        m = pq.read_metadata(f)
        i = m.schema.names.index("lookup")
        held += [f for g in range(m.num_row_groups) if (t := m.row_group(g).column(i).statistics) and t.has_min_max and t.min <= "1942" <= t.max and "=Period" in f]
    periods = [f for f in files if "=Period" in f]
    assert len(periods) > len(set(held)) >= 1


def test_throttle():
    now, slept = [0.0], []
    t = extraction.Throttle(2, 60, lambda: now[0], lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    for _ in range(5):
        t.wait()
    assert slept == [60.0, 60.0]


def test_upserts_are_idempotent(spark):
    rows = [("a", "T", ["T"], "A", '{"x":1}', ["d"], 0)]
    make = lambda rows: spark.createDataFrame(rows, "entity_id string, entity_type string, labels array<string>, name string, p string, sources array<string>, first_doc_ord long").withColumn("properties", properties.parse(F.col("p"))).drop("p")
    old, new = make(rows), make([("a", "U", ["U"], "A2", '{"y":2}', ["e"], 3), ("b", "T", ["T"], "B", "{}", ["e"], 3)])
    once = loading.upsert_nodes(old, new)
    twice = loading.upsert_nodes(once, new)
    plain = lambda df: sorted((r.entity_id, r.entity_type, sorted(r.labels), r.name, r.p, r.first_doc_ord) for r in df.withColumn("p", F.to_json("properties")).collect())
    assert plain(once) == plain(twice) == [("a", "U", ["T", "U"], "A2", '{"x":1,"y":2}', 0), ("b", "T", ["T"], "B", "{}", 3)]
    assert loading.violations(twice, "entity_id").isEmpty()


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame([("a", "Company", "Alpha_1"), ("b", "Geography", "Beta"), ("c", "Company", "alpha%"), ("d", "Company", None)], "entity_id string, entity_type string, name string")
    edges = spark.createDataFrame([("a", "R", "b"), ("a", "S", "b"), ("b", "R", "a"), ("c", "R", "c"), ("b", "R", "c")], "src string, type string, tgt string")
    return GraphSession(spark, nodes, edges, prefix="t_")


def test_search_and_expand(graph):
    ids = lambda df: sorted(r.entity_id for r in df.collect())
    assert ids(graph.search("ALPHA")) == ["a", "c"] and ids(graph.search("_")) == ["a"] and ids(graph.search("")) == ["a", "b", "c"]
    assert ids(graph.search("alpha", "Geography")) == []
    assert graph.neighbors("c").count() == 2  # the loop once
    assert graph.neighbors("a").count() == 3
    two = [(r.mid_id, r.end_id) for r in graph.neighbors("a", 5).filter("depth = 2").collect()]
    assert sorted(two) == [("b", "a")] * 6 + [("b", "c")] * 3  # back through a parallel edge, never the same one
    assert graph.neighbors("a", 2, "S").count() == 1
    with pytest.raises(ValueError):
        graph.neighbors("a", 0)
    assert shortest_path(graph.edges, "a", "c") == 2 and shortest_path(graph.edges, "a", "zz") is None


def test_shortest_paths_equal_a_search(spark):
    rng = random.Random(4)
    rows = list({(f"n{rng.randrange(30)}", rng.choice("RS"), f"n{rng.randrange(30)}") for _ in range(33)})
    near = {}
    for a, _, b in rows:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def plain(a, most):
        found, front = {a: 0}, [a]
        for d in range(1, most + 1):
            front = [y for x in front for y in near.get(x, ()) if y not in found and not found.update({y: d})]
        return found

    pairs = [(f"n{i}", f"n{j}") for i in range(31) for j in range(0, 31, 3)] + [("n1", None), ("n1", "n3"), ("zz", "zz"), ("zz", "n1")]
    edges = spark.createDataFrame(rows, "src string, type string, tgt string")
    for most in (0, 3, 10):
        found = shortest_paths(edges, spark.createDataFrame(pairs, "start_id string, end_id string"), most).collect()
        want = {(a, b): plain(a, most)[b] for a, b in pairs if b is not None and b in plain(a, most)}
        assert {(r.start_id, r.end_id): r.length for r in found} == want and len(found) == len(want)
        for r in found:
            assert len(r.path) == r.length + 1 and (r.path[0], r.path[-1]) == (r.start_id, r.end_id) and all(y in near[x] for x, y in zip(r.path, r.path[1:]))


def test_hubs_are_not_opened_from_many_starts(spark, monkeypatch):
    """300 leaves of three hubs, each asked for its way to another hub's end: the searches go from the ends."""
    from loomgraph.plans import patterns

    leaves, n = [(f"leaf{i}", "T", f"hub{i % 3}") for i in range(300)], []
    ends = [(f"hub{h}", "T", f"end{h}") for h in range(3)] + [("leaf0", "T", "mid"), ("leaf1", "T", "mid"), ("leaf2", "T", "mid")]
    edges = spark.createDataFrame(leaves + ends, "src string, type string, tgt string")
    pairs = spark.createDataFrame([(f"leaf{i}", f"end{(i + 1) % 3}") for i in range(300)], "start_id string, end_id string")
    grown = patterns._grown
    monkeypatch.setattr(patterns, "_grown", lambda *a: n.append((made := grown(*a)).count()) or made)
    found = shortest_paths(edges, pairs, 6).collect()
    assert len(found) == 300 and all(len(r.path) == r.length + 1 and r.path[0] == r.start_id and r.path[-1] == r.end_id for r in found)
    assert max(n) <= 3 * 310  # all nodes from each end; from each start it were 100 leaves of its hub


def test_frontiers_have_no_more_rows_than_nodes_for_each_root(spark, monkeypatch):
    """Suppliers with many products each ask for regions: fewer edges lie before the many starts than before the three
    ends, but those lead to a row for each edge."""
    from loomgraph.plans import patterns

    rng = random.Random(5)
    rows = [(f"nation{i}", "T", f"region{i % 3}") for i in range(6)] + [(f"customer{i}", "T", f"nation{i % 6}") for i in range(60)] + [(f"supplier{i}", "T", f"nation{i % 6}") for i in range(60)]
    rows += [(f"supplier{i}", "T", f"product{p}") for i in range(60) for p in rng.sample(range(100), 40)]
    pairs = [(f"{k}{i}", f"region{(i // 6) % 3}") for k in ("customer", "supplier") for i in range(60)]
    near, n = {}, []
    for a, _, b in rows:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    far = {f"region{r}": {f"region{r}": 0} for r in range(3)}
    for root, found in far.items():
        front = [root]
        for d in range(1, 7):
            front = [y for x in front for y in near[x] if y not in found and not found.update({y: d})]
    grown = patterns._grown
    monkeypatch.setattr(patterns, "_grown", lambda *a: n.append((made := grown(*a)).count()) or made)
    found = shortest_paths(spark.createDataFrame(rows, "src string, type string, tgt string"), spark.createDataFrame(pairs, "start_id string, end_id string"), 6).collect()
    assert {(r.start_id, r.end_id): r.length for r in found} == {(a, b): far[b][a] for a, b in pairs} and max(r.length for r in found) == 6
    assert all(len(r.path) == r.length + 1 and (r.path[0], r.path[-1]) == (r.start_id, r.end_id) and all(y in near[x] for x, y in zip(r.path, r.path[1:])) for r in found)
    assert max(n) <= 3 * len(near)
    assert n[-1] <= 3 * 6  # the last one is of nations alone, where the customers' own searches are


def test_edges_of_line_items_are_told_apart_by_numbers(spark):
    from loomgraph.sources import tables

    plan = tables.edges(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    told = next(line for line in plan.splitlines() if "Aggregate" in line)
    assert "Aggregate [l_suppkey" in told and "concat" not in told.split("], [")[0]


def test_limit_that_the_first_hop_fills(spark):
    """At a hub the second hop is not planned; the rows are those of the whole order."""
    rows = [("hub", "R", f"a{i:03d}") for i in range(60)] + [(f"a{i:03d}", "S", f"b{i % 7}") for i in range(60)]
    edges = spark.createDataFrame(rows, "src string, type string, tgt string")
    few, all_ = retrieval.neighbors(edges, "hub", 2, limit=50), retrieval.neighbors(edges, "hub", 2, limit=None)
    order = lambda df: sorted((r.depth, r.end_id, r.mid_id or "") for r in df.collect())
    assert order(few) == order(all_)[:50] and few._jdf.queryExecution().optimizedPlan().toString().count("Join") < all_._jdf.queryExecution().optimizedPlan().toString().count("Join")
    assert order(retrieval.neighbors(edges, "hub", 2, limit=70)) == order(all_)[:70]


def test_patterns(graph):
    m = Match(graph.nodes, graph.edges)
    assert m.node("x", "Company").edge("r", "R", direction="both").node("y", "Geography").frame.count() == 3
    chain = m.node("x", entity_id="a").edge("r", hops=(1, 2)).node("y")
    assert sorted(r.y for r in chain.returns(y=F.col("y.entity_id")).collect()) == ["a", "a", "b", "b", "c", "c"]
    assert m.node("x").exists("S").returns(i=F.col("x.entity_id")).first().i == "a"
    assert m.node("x").edge("r", "S", optional=True).node("y").frame.count() == 4


def test_whole_tables_of_nodes_are_not_sent_to_all_tasks(spark):
    from loomgraph.queries import QUERIES

    plan = QUERIES["pattern_union"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") and "BroadcastHashJoin" not in plan


def test_optional_ends_are_not_sent_to_all_tasks(spark):
    from loomgraph.queries import QUERIES

    plan = QUERIES["pattern_optional"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [_there" in plan


def test_edges_of_larger_tables_are_dealt_into_more_partitions(spark, monkeypatch):
    """A partition's rows, and with them a task's memory, stay as they are where the line items grow; so do the results."""
    from loomgraph.queries import QUERIES
    from loomgraph.sources import tables

    sf_dir = "/root/testdata/sf0.001"
    made = lambda: (tables.edges(spark, sf_dir).filter("type = 'HAS_SEGMENT'"), QUERIES["pattern_optional"](spark, sf_dir))
    whole = [sorted(map(tuple, df.collect())) for df in made()]
    monkeypatch.setattr(tables, "PARTITION_ROWS", 500, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # these tables are small enough to be sent to all tasks
    try:
        for df, rows in zip(made(), whole):
            sizes = [r["count"] for r in df.withColumn("at", F.spark_partition_id()).groupBy("at").count().collect()]
            assert len(sizes) >= 10 and max(sizes) <= 500 and sum(sizes) == len(rows) > 1000
            assert sorted(map(tuple, df.collect())) == rows
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(tables, "PARTITION_ROWS", 6000, raising=False)
    assert tables.edge_partitions(spark, sf_dir) is None  # small tables are left to Spark


def test_processed_filings_are_counted_in_one_pass(spark, monkeypatch):
    rows = [("a", "parse", "ok"), ("a", "extract", "ok"), ("b", "parse", "ok"), ("b", "extract", "missing"), ("c", "parse", "failed"), ("c", "extract", "ok"), ("d", "parse", "missing"), (None, "parse", "ok"), ("a", "parse", "ok")]
    states = spark.createDataFrame(rows, "document_id string, stage string, status string")

    def joined(*_, **__):
        raise AssertionError("filings are joined with their states")

    monkeypatch.setattr(type(states), "join", joined)
    assert [tuple(build.fully_processed(states, strict).first()) for strict in (True, False)] == [(5, 1), (5, 2)]
    assert tuple(build.fully_processed(states.limit(0)).first()) == (0, 0)


def test_guard(spark, graph):
    assert graph.sql("WITH x AS (SELECT src FROM t_edges WHERE type = :t) SELECT count(*) AS n FROM x", {"t": "R"}).first().n == 4
    assert graph.sql("SELECT 'insert set create' AS x").count() == 1
    for bad in ("CREATE TABLE z AS SELECT 1", "INSERT INTO t_nodes VALUES (1)", "SET a=b", "DROP VIEW t_nodes", "CACHE TABLE t_nodes"):
        with pytest.raises(NotReadOnly):
            check(spark, bad)
    assert not spark.catalog.tableExists("z")


def test_agent_states(graph):
    call, turn = agent.Call, agent.Reply
    answer = lambda q, e: "made from evidence"
    ask = lambda *turns, **k: agent.ask(graph, "q", agent.ScriptedPlanner(*turns), answer, **k)
    r = ask(turn([call("assess_query", {"intent": "i"}), call("plan_retrieval", {"data_items": [1]})]), turn([call("search_nodes", {"query": "alpha"}), call("nope")]), turn([call("submit_answer", {"has_sufficient_data": True, "answer": "yes", "confidence": "HIGH"})]))
    assert (r.answer, r.confidence, r.assessment, r.plan, len(r.tool_calls)) == ("yes", "HIGH", {"intent": "i"}, [1], 5) and "Alpha_1" in r.graph_context
    assert (ask(turn(text="plain")).answer, ask(turn(text="plain")).confidence) == ("plain", "MEDIUM")
    assert ask(turn()).answer == agent.NO_ANSWER
    forced = ask(rounds=2)
    assert (forced.answer, forced.confidence, forced.has_sufficient_data) == ("made from evidence", "LOW", False)
    assert ask(turn([call("submit_answer", {"has_sufficient_data": True, "answer": ""})]), turn(text="late")).answer == "made from evidence"
    assert ask(turn([call("submit_answer", {"has_sufficient_data": False, "answer": ""})]), turn(text="late")).answer == ""
    got = ask(turn([call("get_neighbors", {"entity_id": "a", "depth": 0}), call("run_query", {"query": "DROP VIEW t_nodes"}), call("run_query", {"query": "SELECT nothing FROM t_nodes"})]), turn(text="x"))
    assert "DROP" not in got.graph_context and "QUERY RESULTS" in got.graph_context


def test_chat_boundaries(graph):
    seen = []

    def complete(messages, tools):
        seen.append((messages, tools))
        if tools and len(seen) == 1:
            return {"content": None, "tool_calls": [{"name": "search_nodes", "arguments": '{"query": "beta"}'}, {"name": "search_nodes", "arguments": "{bad"}]}
        return {"content": "from the model"}

    r = agent.ask(graph, "q", chat.ChatPlanner(complete), chat.ChatAnswerer(complete))
    assert r.answer == "from the model" and "Beta" in r.graph_context and len(seen[0][1]) == 6
    assert {t["function"]["name"] for t in chat.tool_definitions()} == set(agent.TOOLS)
    assert chat.ChatExtractor(complete, 2024)("d", "1-3", "text", ["a"]) == "from the model" and "2024" in seen[-1][0][1]["content"]


def test_command_line(spark, tmp_path, capsys):
    from loomgraph.__main__ import main

    (tmp_path / "in").mkdir()
    page = {"page_number": 1, "blocks": [{"block_type": "text", "block_order": 0, "content": "Acme operates in India"}]}
    (tmp_path / "in" / "d.json").write_text(json.dumps({"id": "d", "name": "d", "pages": [page]}))
    main(["build", str(tmp_path / "in"), str(tmp_path / "g")])
    main(["summary", str(tmp_path / "g")])
    main(["search", str(tmp_path / "g"), "acme"])
    (tmp_path / "x.json").write_text(json.dumps({"document_id": "d", "entities": [{"id": "company_z", "type": "Company", "properties": {"name": "Z"}}]}))
    main(["ingest", str(tmp_path / "x.json"), str(tmp_path / "g2")])
    main(["search", str(tmp_path / "g2"), "z", "--type", "Company"])
    out = capsys.readouterr().out
    assert "OPERATES_IN: 1" in out and "company_acme" in out and "company_z" in out


def test_evidence_text():
    e = Evidence()
    assert e.text() == NOTHING and e.empty()
    e.add_nodes([{"entity_id": "a", "entity_type": "T", "name": None}, {"entity_id": "a", "name": "later"}])
    e.add_relationships([{"src": "a", "type": "R", "tgt": "b"}] * 2)
    assert e.text() == "=== NODES ===\n- [T] a (id=a)\n\n=== RELATIONSHIPS ===\n- (a) -[R]-> (b)"


def test_json_round_trip_and_stream(spark, tmp_path):
    blocks = spark.createDataFrame([("d", 0, 1, 0, "text", 0, "é"), ("d", 1, 2, 0, "text", 0, "y")], documents.BLOCKS)
    documents.write_json(documents.tree(blocks), str(tmp_path / "parsed"), "id")
    again = documents.blocks_of_tree(documents.read_parsed(spark, str(tmp_path / "parsed")))
    assert sorted(r.content for r in again.collect()) == ["y", "é"]
    folder = tmp_path / "in"
    folder.mkdir()
    result = lambda name, key: (folder / name).write_text(json.dumps({"document_id": name, "entities": [{"id": key, "type": "Company", "properties": {"name": key}}], "relationships": [{"source_id": key, "target_id": "a", "type": "RELATED_TO", "properties": {}}], "errors": []}))
    graph = incremental.Graph(str(tmp_path / "graph"))
    for name, key in (("1.json", "a"), ("2.json", "b")):
        result(name, key)
        incremental.load(incremental.read_stream(spark, str(folder)), graph, str(tmp_path / "cp")).start().awaitTermination()
    nodes, edges = (graph.read(spark)[t] for t in ("nodes", "edges"))
    assert sorted(r.entity_id for r in nodes.collect()) == ["a", "b"]
    assert sorted((r.src, r.tgt) for r in edges.collect()) == [("a", "a"), ("b", "a")]
    assert documents.read_extractions(spark, str(folder)).count() == 2
    assert schemas.SOURCE
