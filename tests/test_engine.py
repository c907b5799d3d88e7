"""Batches against one batch, the read-only guard, edges with their properties, and names that many records share."""

import json
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import evidence, extraction, resolution, retrieval
from loomgraph.plans import agent, pipeline
from loomgraph.plans.guard import NotReadOnly, check_analysed
from loomgraph.plans.session import GraphSession, Settings
from loomgraph.streaming import incremental



def files(rng, n):
    out = []
    for i in range(n):
        name = lambda: rng.choice(["Infosys Limited", "Infosys Limite", "Wipro", "WIPRO", "Tata Steel", "Steel Tata", "Tata Steels", "Acme"])
        entities = [{"id": f"c{rng.randrange(9)}", "type": rng.choice(["Company", "Person"]), "properties": {"name": name(), **{k: rng.choice([1, None, "x", [1, 2]]) for k in rng.sample("pqr", 2)}}, "source": {"page_num": i, "section": "s"}} for _ in range(rng.randint(0, 5))]
        ids = [e["id"] for e in entities] + ["c0"]
        relations = [{"source_id": rng.choice(ids), "target_id": rng.choice(ids), "type": rng.choice("RS"), "properties": {"filing_year": rng.choice([2023, 2024]), "v": i}} for _ in range(rng.randint(0, 4))]
        out.append({"document_id": f"d{i}", "entities": entities, "relationships": relations, "errors": []})
    return out


def plain(tables):
    nodes = tables["nodes"].select("entity_id", "entity_type", "name", F.to_json("properties").alias("p"), "sources", "first_doc_ord").collect()
    edges = tables["edges"].select("src", "type", "tgt", F.to_json("properties").alias("p"), "sources").collect()
    return sorted((r.entity_id, r.entity_type, r.name, sorted(json.loads(r.p or "{}").items(), key=repr), r.sources, r.first_doc_ord) for r in nodes), sorted((r.src, r.type, r.tgt, sorted(json.loads(r.p or "{}").items()), r.sources) for r in edges)


def loaded(spark, at, found, cuts):
    """The graph of files that come in some batches."""
    folder = at / "in"
    folder.mkdir(parents=True)
    graph, begin = incremental.Graph(str(at / "graph")), 0
    for end in cuts:
        for i in range(begin, end):
            (folder / f"{i:03d}.json").write_text(json.dumps(found[i]))
        incremental.load(incremental.read_stream(spark, str(folder)), graph, str(at / "cp")).start().awaitTermination()
        begin = end
    return graph


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_batches_equal_one_batch(spark, tmp_path, seed):
    """Also where files share a document_id or have none."""
    rng = random.Random(seed)
    found = files(rng, 6)
    if seed > 1:
        for f in found:
            f["document_id"] = rng.choice(["same", "other", None])
    one, three = loaded(spark, tmp_path / "one", found, [6]), loaded(spark, tmp_path / "three", found, [2, 3, 6])
    a, b = plain(one.read(spark)), plain(three.read(spark))
    assert a == b and len(a[0]) > 2 and len(a[1]) > 2


def test_a_batch_writes_what_it_changes(spark, tmp_path):
    entity = lambda i, **p: {"id": f"c{i}", "type": "Company", "properties": {"name": chr(97 + i) * 9, **p}}
    link = lambda a, b: {"source_id": f"c{a}", "target_id": f"c{b}", "type": "R", "properties": {}}
    found = [
        {"document_id": "d0", "entities": [entity(i) for i in range(20)], "relationships": [link(i, i + 1) for i in range(19)]},
        {"document_id": "d1", "entities": [entity(3, k=1), entity(21)], "relationships": [link(3, 4), link(21, 5)]},
        {"document_id": "d2", "entities": [], "relationships": [link(0, 99), link(1, 2)]},
    ]
    graph = loaded(spark, tmp_path, found, [1, 2, 3])
    counts = lambda t: {r.version: r["count"] for r in spark.read.parquet(f"{graph.path}/{t}").groupBy("version").count().collect()}
    assert counts("nodes") == counts("state") == {0: 20, 1: 2} and counts("edges") == {0: 19, 1: 2, 2: 1}
    last = graph.read(spark)
    assert last["nodes"].count() == 21 and last["files"].count() == 3
    (row,) = last["nodes"].filter("entity_id = 'c3'").collect()
    assert row.sources == ["d0", "d1"] and row.first_doc_ord == 0


def test_an_unfinished_batch_is_not_seen_and_written_again(spark, tmp_path, monkeypatch):
    found = files(random.Random(5), 4)
    whole = plain(loaded(spark, tmp_path / "whole", found, [4]).read(spark))
    graph = loaded(spark, tmp_path / "half", found, [2])
    before = plain(graph.read(spark))
    for i in (2, 3):
        (tmp_path / "half" / "in" / f"{i:03d}.json").write_text(json.dumps(found[i]))
    write = incremental.Graph.write

    def lost(self, version, changed):
        write(self, version, {**changed, "files": changed["files"].limit(0)})
        raise RuntimeError("lost")

    monkeypatch.setattr(incremental.Graph, "write", lost)
    with pytest.raises(Exception, match="lost"):
        incremental.load(incremental.read_stream(spark, str(tmp_path / "half" / "in")), graph, str(tmp_path / "half" / "cp")).start().awaitTermination()
    monkeypatch.undo()
    assert plain(graph.read(spark)) == before
    incremental.load(incremental.read_stream(spark, str(tmp_path / "half" / "in")), graph, str(tmp_path / "half" / "cp")).start().awaitTermination()
    assert plain(graph.read(spark)) == whole


def test_later_files_of_a_batch_win(spark, tmp_path):
    (tmp_path / "in").mkdir()
    entity = lambda **p: [{"id": "company_a", "type": "Company", "properties": p, "source": {"page_num": 1, "section": "s"}}]
    filler = [{"id": f"x{i}", "type": "Company", "properties": {"name": f"other thing {i} {'abc'[i]}"}} for i in range(3)]
    (tmp_path / "in" / "1.json").write_text(json.dumps({"document_id": "one", "entities": filler + entity(name="Alpha", k="Old", only="first")}))
    (tmp_path / "in" / "2.json").write_text(json.dumps({"document_id": "two", "entities": entity(name="Alpha", k="New")}))
    graph = incremental.Graph(str(tmp_path / "graph"))
    incremental.load(incremental.read_stream(spark, str(tmp_path / "in")), graph, str(tmp_path / "cp")).start().awaitTermination()
    row = graph.read(spark)["nodes"].filter("entity_id = 'company_a'").select(F.to_json("properties").alias("p"), "sources").first()
    assert json.loads(row.p) == {"name": "Alpha", "k": "New", "only": "first"} and row.sources == ["one", "two"]


def test_no_row_grows_with_its_file(spark, tmp_path):
    """Files of events are dealt over rows, whose records are in the order of the events."""
    from datetime import datetime

    from loomgraph.sources import documents, tables

    ids = random.Random(3).sample(range(1000), 300)
    rows = [(i, datetime(2024, 1, 1, 5, i % 60), i % 7, "AB"[i % 2], float(i), "{}") for i in ids]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    found = tables.event_files(spark, str(tmp_path))
    assert {r[0] for r in found.select("file_path").distinct().collect()} == {"events_2024010105"}
    assert found.agg(F.max(F.size("relationships"))).first()[0] == 1 and found.agg(F.max(F.size("entities"))).first()[0] == 2
    entities, relationships = documents.records(found.withColumn("doc_ord", F.lit(2).cast("long")))
    got = [r.id for r in entities.orderBy("seq").collect()]
    assert got == [x for i in sorted(ids) for x in (f"person_{i % 7}", "event_" + "AB"[i % 2])]
    assert [r.e for r in relationships.select("seq", F.expr("variant_get(properties['event_id'], '$', 'long')").alias("e")).orderBy("seq").collect()] == sorted(ids)
    assert entities.select("seq").distinct().count() == 600 and entities.agg(F.min("seq")).first()[0] == 2 << 40


def test_records_with_a_leader_of_their_id_are_not_compared_by_name(spark, monkeypatch):
    names = ["acme steel works", "acme steel work", "wipro", "tata motors", "infosys"]
    rows = [("d", 0, 10 + i, f"id{i}", "A", n) for i, n in enumerate(names)] + [("d", 0, 20 + i, f"id{i}", "A", n) for i, n in enumerate(names)]
    records = spark.createDataFrame(rows, "document_id string, doc_ord long, seq long, id string, type string, name string")
    asked, similar = [], resolution.similar
    monkeypatch.setattr(resolution, "similar", lambda left, *more: asked.append([r.name for r in left.select("name").collect()]) or similar(left, *more))
    got = [r.canonical_id for r in resolution.assign(records).orderBy("seq").collect()]
    assert got == ["id0", "id0", "id2", "id3", "id4"] * 2 and asked[-1] == ["acme steel work"]
    known = records.filter("seq < 20 AND id <> 'id1'").select("id", "type", "name", "seq")
    asked.clear()
    later = resolution.assign(records.filter("seq >= 20 AND id <> 'id1'"), known=known)
    assert [r.canonical_id for r in later.orderBy("seq").collect()] == ["id0", "id2", "id3", "id4"] and asked == [[]]


def test_guard_knows_tables_and_functions(spark):
    nodes = spark.createDataFrame([("a", "T", "A")], "entity_id string, entity_type string, name string")
    g = GraphSession(spark, nodes, spark.createDataFrame([("a", "R", "a")], "src string, type string, tgt string"), prefix="g_")
    nodes.createOrReplaceTempView("other")
    spark.udf.register("own_function", lambda x: x)
    for good in (
        "WITH x AS (SELECT upper(src) AS u FROM g_edges) SELECT u, count(*) AS n FROM x WHERE u IN (SELECT upper(entity_id) FROM g_nodes) GROUP BY u",
        "SELECT n.name, (SELECT max(src) FROM g_edges) AS m FROM g_nodes n WHERE EXISTS (SELECT 1 FROM g_edges e WHERE e.src = n.entity_id)",
        "SELECT id FROM range(2)", "SELECT explode(array(1, 2)) AS x", "SELECT sum(1) OVER (ORDER BY name) AS s FROM g_nodes",
    ):
        assert g.sql(good).collect()
    for bad in (
        "SELECT reflect('java.lang.System', 'setProperty', 'a', 'b')", "SELECT 1 FROM g_nodes WHERE java_method('a', 'b') = 1", "SELECT transform(array(1), x -> try_reflect('a', 'b'))",
        "SELECT * FROM text.`/etc/hostname`", "SELECT * FROM other", "SELECT 1 FROM g_nodes WHERE name IN (SELECT value FROM text.`/etc/hostname`)",
        "SELECT (SELECT max(value) FROM text.`/etc/hostname`) FROM g_nodes", "WITH x AS (SELECT * FROM parquet.`/tmp`) SELECT * FROM x", "SELECT own_function(1)", "SELECT a.b.c(1)",
        "SELECT name FROM g_nodes ORDER BY reflect('a', 'b')",
    ):
        with pytest.raises(NotReadOnly):
            g.sql(bad)


def test_guard_looks_at_what_names_stand_for(spark):
    nodes = spark.createDataFrame([("a", "T", "A")], "entity_id string, entity_type string, name string")
    noted = F.udf(lambda x: x)
    g = GraphSession(spark, nodes.withColumn("name", noted("name")), spark.createDataFrame([("a", "R", "a")], "src string, type string, tgt string"), prefix="h_")
    spark.udf.register("own_function", lambda x: x)
    nodes.createOrReplaceTempView("hidden")
    for good in (
        "SELECT upper(name) AS n, nvl(name, 'x'), lpad(name, 3, 'z'), date_trunc('year', current_timestamp()), try_to_number('1', '9'), regexp_count(name, 'A') FROM h_nodes",
        "SELECT transform(array(1, 2), x -> x + 1) AS t, named_struct('a', 1).a, CASE WHEN name LIKE 'A%' THEN 1 ELSE 2 END FROM h_nodes",
        "SELECT n.name, e.k FROM h_nodes n LATERAL VIEW explode(array(1, 2)) e AS k", "SELECT * FROM h_nodes n, LATERAL (SELECT count(*) AS c FROM h_edges e WHERE e.src = n.entity_id)",
        "SELECT entity_type, percentile_approx(length(name), 0.5), collect_list(name), count_if(name = 'A') FROM h_nodes GROUP BY ROLLUP (entity_type)",
        "SELECT * FROM h_nodes PIVOT (count(*) FOR entity_type IN ('T', 'U'))", "SELECT rank() OVER (PARTITION BY type ORDER BY src) FROM h_edges", "VALUES (1), (2)",
        "WITH RECURSIVE r(id, n) AS (SELECT 'a', 0 UNION ALL SELECT e.tgt, n + 1 FROM r JOIN h_edges e ON e.src = r.id WHERE n < 3) SELECT * FROM r",
        "SELECT name FROM h_nodes WHERE entity_id IN (SELECT src FROM h_edges) UNION SELECT 'b' ORDER BY name LIMIT 5 OFFSET 0", "SELECT x.id FROM range(3) AS x", "SELECT name FROM h_nodes TABLESAMPLE (100 PERCENT)",
    ):
        assert g.sql(good).collect(), good
    assert g.sql("SELECT name FROM h_nodes WHERE name = :n", {"n": "A"}).count() == 1
    for bad in (
        "SELECT IDENTIFIER('reflect')('java.lang.System', 'getProperty', 'user.dir')", "SELECT IDENTIFIER('own_function')(name) FROM h_nodes", "SELECT * FROM IDENTIFIER('hidden')", "SELECT IDENTIFIER('name') FROM h_nodes",
        "SELECT IDENTIFIER('re' || 'flect')('java.lang.System', 'getProperty', 'user.dir')", "SELECT * FROM python_worker_logs()", "SELECT input_file_name() FROM h_nodes", "SELECT input_file_block_start() FROM h_nodes",
        "SELECT raise_error('x')", "SELECT assert_true(false)", "SELECT try_reflect('java.lang.System', 'getProperty', 'user.dir')", "SELECT * FROM h_nodes LATERAL VIEW own_function(name) x",
        "SELECT system.builtin.reflect('java.lang.System', 'getProperty', 'user.dir')", "SELECT `reflect`('java.lang.System', 'getProperty', 'user.dir')", "SELECT (SELECT own_function(max(name)) FROM h_nodes)",
        "SELECT * FROM h_nodes ORDER BY own_function(name)", "SELECT filter(array(name), x -> own_function(x) = 'A') FROM h_nodes", "SELECT count(*) FILTER (WHERE own_function(name) = 'A') FROM h_nodes",
        "SET spark.sql.ansi.enabled = false", "CREATE TEMP VIEW v AS SELECT 1", "INSERT INTO h_nodes SELECT * FROM h_nodes", "CACHE TABLE h_nodes", "DESCRIBE h_nodes", "EXPLAIN SELECT 1", "DROP VIEW h_nodes", "SHOW TABLES",
        "BEGIN SELECT 1; END", "EXECUTE IMMEDIATE 'SELECT 1'", "DECLARE VARIABLE v INT", "SELECT TRANSFORM(name) USING 'cat' FROM h_nodes", "ADD JAR '/tmp/x.jar'", "SELECT * FROM json.`/tmp`", "TABLE hidden", "FROM hidden |> SELECT name",
        "FROM h_nodes |> EXTEND own_function(name) AS x", "SELECT * FROM csv.`/etc/passwd` AS h_nodes",
    ):
        with pytest.raises(NotReadOnly):
            g.sql(bad)
            pytest.fail(bad)


def test_guard_of_the_analysed_plan_alone(spark):
    """What the parsed text might let pass is found again by what it was resolved to."""
    nodes = spark.createDataFrame([("a", "T", "A")], "entity_id string, entity_type string, name string")
    nodes.createOrReplaceTempView("an_nodes")
    nodes.createOrReplaceTempView("an_other")
    spark.udf.register("own_function", lambda x: x)
    check_analysed(spark, spark.sql("SELECT upper(name) FROM an_nodes WHERE entity_id IN (SELECT entity_id FROM an_nodes)"), ["an_nodes"])
    for bad in (
        "SELECT own_function(name) FROM an_nodes", "SELECT IDENTIFIER('own_function')(name) FROM an_nodes", "SELECT reflect('java.lang.System', 'getProperty', 'user.dir')", "SELECT try_reflect('java.lang.System', 'getProperty', 'user.dir')",
        "SELECT * FROM an_other", "SELECT * FROM an_nodes WHERE name IN (SELECT value FROM text.`/etc/hostname`)", "SELECT input_file_name() FROM an_nodes", "SELECT * FROM text.`/etc/hostname`", "SELECT raise_error('x')",
    ):
        with pytest.raises(NotReadOnly):
            check_analysed(spark, spark.sql(bad), ["an_nodes"])
            pytest.fail(bad)


def test_edges_and_evidence_keep_properties_and_sources(spark):
    nodes = spark.createDataFrame([(k, "T", k.upper(), [f"doc_{k}"], 3) for k in "abc"], "entity_id string, entity_type string, name string, sources array<string>, first_doc_ord int")
    rows = [("a", "R", "b", '{"filing_year": 2024}', ["d1"]), ("b", "S", "c", '{"amount": 5}', ["d2"]), ("a", "R", "a", "{}", ["d3"])]
    edges = spark.createDataFrame(rows, "src string, type string, tgt string, p string, sources array<string>").withColumn("properties", F.from_json("p", "map<string,variant>")).drop("p")
    g = GraphSession(spark, nodes, edges, prefix="k_")
    found = retrieval.edges_on(g.neighbors("a", 2)).select("src", "type", "tgt", F.to_json("properties").alias("p"), "sources").collect()
    assert sorted((r.src, r.tgt, r.p, tuple(r.sources)) for r in found) == [("a", "a", "{}", ("d3",)), ("a", "b", '{"filing_year":2024}', ("d1",)), ("b", "c", '{"amount":5}', ("d2",))]
    kept = evidence.Evidence()
    out = agent.Tools(g, kept).call(agent.Call("get_neighbors", {"entity_id": "a", "depth": 2}))
    assert out["nodes_found"] == 3 and all("sources" not in n for n in out["nodes"])
    assert "[T] B (id=b)  [sources: doc_b]" in kept.text() and "first_doc_ord" not in kept.text() and "2024" in kept.text()


def test_many_records_of_one_name(spark):
    """Two thousand records of one name or one id follow its leader, without their pairs."""
    rows = [("d", 0, i, f"id{i}" if i % 2 else "same", "Company", "Acme Limited" if i % 2 else f"name {'abcdefgh'[i % 8] * 9} {i % 5}") for i in range(4000)]
    records = spark.createDataFrame(rows, "document_id string, doc_ord long, seq long, id string, type string, name string")
    lead = resolution.leaders(records).filter("is_leader").select("id", "seq").collect()
    assert sorted((r.id, r.seq) for r in lead) == [("id1", 1), ("same", 0)]
    done = resolution.assign(records).groupBy("canonical_id").count().collect()
    assert {r.canonical_id: r["count"] for r in done} == {"id1": 2000, "same": 2000}


def page_parser(path, content):
    """Pages are parted by form feeds, blocks by line feeds."""
    text = content.decode()
    if text.startswith("broken"):
        raise ValueError(path)
    return [(i, i + 1, j, "text", j, line) for i, page in enumerate(text.split("\f")) for j, line in enumerate(page.split("\n"))]


class Counting:
    """The offline extractor; each call leaves a file."""

    def __init__(self, folder):
        self.folder = folder

    def __call__(self, document_id, page_range, content, known_ids):
        import uuid

        with open(f"{self.folder}/{document_id}-{page_range}-{uuid.uuid4().hex}", "w"):
            pass
        return extraction.NameExtractor()(document_id, page_range, content, known_ids)


def test_pipeline_takes_what_is_new(spark, tmp_path):
    raw, calls = tmp_path / "raw", tmp_path / "calls"
    calls.mkdir()
    settings = tmp_path / "settings.json"
    settings.write_text(json.dumps({k: str(tmp_path / k) for k in ("raw", "parsed", "extracted", "graph")}))
    settings = Settings.read(str(settings))

    def filing(place, text):
        (raw / place).parent.mkdir(parents=True, exist_ok=True)
        (raw / place).write_text(text)

    def run(**options):
        states = {(r.document_id, r.stage): r.status for r in pipeline.run(spark, settings, page_parser, Counting(str(calls)), **options).collect()}
        last = incremental.Graph(settings.graph).read(spark)
        made = sorted(p.name.split("-")[0] for p in calls.iterdir())
        for p in calls.iterdir():
            p.unlink()
        return states, sorted(r.entity_id for r in last["nodes"].collect()), sorted((r.src, r.tgt, tuple(r.sources)) for r in last["edges"].collect()), made

    filing("Acme/2023/Form A.pdf", "Acme operates in India\fnothing here\f\fAcme operates in Peru")
    filing("Acme/2024/Bad.pdf", "broken")
    states, nodes, edges, made = run()
    assert states == {("acme_form_a", s): "ok" for s in ("parse", "extract", "load")} | {("acme_bad", s): "missing" for s in ("parse", "extract", "load")}
    assert nodes == ["company_acme", "geography_india", "geography_peru"] and made == ["acme_form_a"] * 2
    assert edges == [("company_acme", "geography_india", ("acme_form_a",)), ("company_acme", "geography_peru", ("acme_form_a",))]
    assert run()[1:] == (nodes, edges, [])
    filing("Zed/2024/b.PDF", "Zed Works operates in India")
    states, nodes, edges, made = run()
    assert made == ["zed_b"] and "company_zed_works" in nodes and ("company_zed_works", "geography_india", ("zed_b",)) in edges and len(edges) == 3
    again = run(force=True, company="zed")
    assert again[3] == ["zed_b"] and again[1:3] == (nodes, edges) and set(again[0]) == {("zed_b", s) for s in ("parse", "extract", "load")}
