"""The jobs over growing copies of small tables: new rows alone, the same result again, and after failures."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import common, fiscal_graph, window_feed
from jobs.queries import ORACLES, QUERIES
from loomgraph.operators import windows
from loomgraph.sources import documents

from .test_catalogue import SF, db, rows  # noqa: F401

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LINES = "one\ntwo\n\nfour\nfive\nsix\nseven\n8\n9\nten"


@pytest.mark.parametrize("name", list(QUERIES))
def test_job_equals_sql(name, spark, db):  # noqa: F811
    df, sql = QUERIES[name](spark, SF), db.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert rows(df.columns, df.collect()) == rows(sql.columns, sql.fetchall())


class Feed:
    """A folder of documents that grows, and the job over it."""

    def __init__(self, spark, at: Path):
        self.spark, self.at, self.n = spark, at, 0

    def add(self, *found):
        self.n += 1
        self.spark.createDataFrame(list(found), DOCS).coalesce(1).write.mode("append").parquet(f"{self.at}/in")

    def run(self, **config):
        return window_feed.run(self.spark, f"{self.at}/in", f"{self.at}/out", f"{self.at}/cp", config or None)

    def windows(self):
        found = common.table(self.spark, f"{self.at}/out/windows", window_feed.WINDOWS).collect()
        return sorted((r.document_id, r.window_idx, r.page_range, r.page_content, r.lang, r.batch) for r in found)

    def ledger(self):
        found = common.table(self.spark, f"{self.at}/out/ledger", window_feed.LEDGER).collect()
        return sorted((r.document_id, r.lang, r.source, r.windows, r.status, r.batch) for r in found)


def test_feed_takes_only_what_is_new(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.add((1, LINES, "en", "a", 1), (2, None, None, "b", None), (3, "", "de", "b", 0), (None, "lost", "en", "a", 1), (4, "x", None, None, 1), (4, "b", "en", "z", 1))
    first = feed.run()
    assert first == {"batches": 1, "rows": 6, "without_id": 1, "documents": 4, "empty": 1, "windows": 4}
    before = feed.windows()
    assert [w[:4] for w in before if w[0] == "document_1"] == [
        ("document_1", 0, "1-3", "[Page 1]\none\ntwo\n\n[Page 2]\nfour\nfive\nsix\n\n[Page 3]\nseven\n8\n9"),
        ("document_1", 1, "3-4", "[Page 3]\nseven\n8\n9\n\n[Page 4]\nten"),
    ]
    (fourth,) = [w for w in before if w[0] == "document_4"]  # one of the two rows, with its own text and language
    lang, source = {"[Page 1]\nb": ("en", "z"), "[Page 1]\nx": ("und", None)}[fourth[3]]
    assert fourth[4] == lang
    assert feed.ledger() == [("document_1", "en", "a", 2, "windowed", 0), ("document_2", "und", "b", 0, "empty", 0), ("document_3", "de", "b", 1, "windowed", 0), ("document_4", lang, source, 1, "windowed", 0)]
    assert feed.run() == dict.fromkeys(first, 0) and feed.windows() == before
    feed.add((1, "changed since", "en", "a", 1), (5, "new", "fr", "c", 1))
    assert feed.run() == {"batches": 1, "rows": 2, "without_id": 0, "documents": 1, "empty": 0, "windows": 1}
    assert feed.windows() == sorted([*before, ("document_5", 0, "1-1", "[Page 1]\nnew", "fr", 1)])


def test_feed_in_steps_equals_one_run(spark, tmp_path):
    found = [(i, "\n".join(f"line {j} of {i}" for j in range(i % 23)), ["en", "de", None][i % 3], "s", 1) for i in range(40)]
    one, steps = Feed(spark, tmp_path / "one"), Feed(spark, tmp_path / "steps")
    for k in range(0, 40, 10):
        one.add(*found[k : k + 10])
        steps.add(*found[k : k + 10])
        if k != 10:
            steps.run(max_files=1)
    one.run()
    assert [w[:5] for w in one.windows()] == [w[:5] for w in steps.windows()] and {w[5] for w in steps.windows()} == {0, 1, 2, 3}


def test_feed_after_a_failure(spark, tmp_path, monkeypatch):
    feed = Feed(spark, tmp_path)
    feed.add((1, LINES, "en", "a", 1), (2, "b", "de", "a", 1))
    written = []

    def failing(df, path, *partitions):
        if written:
            raise RuntimeError("lost")
        written.append(path)
        common.overwrite(df, path, *partitions)

    monkeypatch.setattr(window_feed, "overwrite", failing)
    with pytest.raises(Exception, match="lost"):
        feed.run()
    assert len(feed.windows()) == 3 and feed.ledger() == []
    monkeypatch.undo()
    feed.add((3, "c", "en", "a", 1))
    assert feed.run()["documents"] == 3
    assert len(feed.windows()) == len(set(feed.windows())) == 4 and [w[5] for w in feed.windows()] == [0, 0, 0, 1]


def test_feed_moves_no_texts_where_no_id_repeats(spark, tmp_path, monkeypatch):
    def moved(*_):
        raise AssertionError("texts are grouped")

    feed, words = Feed(spark, tmp_path), [*"ab", "", " ", "\t", "\u00a0 x "]
    texts = [None, "", "\n", *("\n".join(words[(i * j) % 6] for j in range(i)) for i in range(1, 25))]
    feed.add(*((i, t, "en", "s", 1) for i, t in enumerate(texts)))
    monkeypatch.setattr(window_feed, "one_of_each", moved)
    feed.run(lines_per_page=2, window_pages=4, window_step=3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    by_blocks = windows.texts(documents.blocks_of_lines(docs, 2), 4, 3).collect()
    assert [w[:4] for w in feed.windows()] == sorted((r.document_id, r.window_idx, r.page_range, r.page_content) for r in by_blocks)
    assert [e[3] for e in feed.ledger() if e[0] == "document_0"] == [0]


def test_feed_takes_repeated_ids_the_same_way_whatever_their_number(spark, tmp_path, monkeypatch):
    found = []
    for few in (10_000, 0):
        monkeypatch.setattr(window_feed, "FEW", few)
        feed = Feed(spark, tmp_path / str(few))
        feed.add(*((i % 7, f"text {i}\n" * (i % 5), ["en", None][i % 2], "s", 1) for i in range(10)))
        feed.run()
        feed.add(*((i % 9, f"later {i}", "de", "t", 1) for i in range(20)), (20, None, "en", "s", 1))
        feed.run()
        found.append((feed.windows(), feed.ledger()))
    assert found[0] == found[1] and [e[0] for e in found[0][1] if e[5] == 1] == ["document_20", "document_7", "document_8"]


def orders(spark, at, found):
    spark.createDataFrame(found, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate string").withColumn("o_orderdate", F.to_timestamp("o_orderdate")).write.mode("append").parquet(str(at))


def test_fiscal_graph_writes_changed_years_alone(spark, tmp_path):
    at, out = tmp_path / "orders", str(tmp_path / "out")
    spark.createDataFrame([(1, "One"), (2, "Two"), (2, "Two again")], "c_custkey long, c_name string").write.parquet(str(tmp_path / "customer"))
    orders(spark, at, [(1, 1, "O", 10.25, "2001-05-01"), (2, 1, "F", 1.5, "2001-06-01"), (3, 2, "O", 7.0, "2002-01-01"), (4, 9, "O", 7.0, "2002-01-01"), (5, 2, "O", 7.0, None), (6, None, "O", 1.0, "2002-02-02")])
    run = lambda **c: fiscal_graph.run(spark, str(at), str(tmp_path / "customer"), out, c or None)
    files = lambda y: sorted(str(p) for p in Path(out).rglob("*.parquet") if f"fiscal_year={y}" in str(p))
    first = run()
    assert first == {"years": 2, "orders": 3, "nodes": 16, "edges": 18}
    kept, changed = files(2001), files(2002)
    assert run() == {"years": 0, "orders": 0, "nodes": 0, "edges": 0} and files(2002) == changed
    orders(spark, at, [(7, 1, "F", 2.0, "2002-03-01"), (8, 2, "F", 1.0, "2003-01-01")])
    assert run()["years"] == 2 and files(2001) == kept and not set(files(2002)) & set(changed)
    nodes = common.table(spark, f"{out}/nodes", fiscal_graph.NODES)
    values = {(r.entity_id, str(r.amount)) for r in nodes.filter("entity_type = 'MetricValue' AND entity_id LIKE '%_order_value_%'").collect()}
    assert values == {(f"metricvalue_order_value_company_{c}_{y}", a) for c, y, a in ((1, 2001, "11.75"), (2, 2002, "7.00"), (1, 2002, "2.00"), (2, 2003, "1.00"))}
    assert {r.name for r in nodes.filter("entity_type = 'Company'").collect()} == {"One", "Two"}
    assert run(metrics=["orders"], years=[2001])["nodes"] == 4  # settings count as a change
    with pytest.raises(ValueError, match="metrics"):
        run(metrics=["profit"])
    with pytest.raises(ValueError, match="unknown settings"):
        run(year=2001)


def test_fiscal_graph_keeps_what_it_has_when_a_check_fails(spark, tmp_path, monkeypatch):
    at, out = tmp_path / "orders", str(tmp_path / "out")
    spark.createDataFrame([(1, "One")], "c_custkey long, c_name string").write.parquet(str(tmp_path / "customer"))
    orders(spark, at, [(1, 1, "O", 10.25, "2001-05-01")])
    fine = fiscal_graph.graph

    def broken(found):
        nodes, edges = fine(found)
        return nodes.filter("entity_type <> 'Period'").unionByName(nodes.filter("entity_type = 'Metric'")), edges

    monkeypatch.setattr(fiscal_graph, "graph", broken)
    with pytest.raises(ValueError, match="not written"):
        fiscal_graph.run(spark, str(at), str(tmp_path / "customer"), out)
    assert not os.path.exists(out)
    monkeypatch.undo()
    assert fiscal_graph.run(spark, str(at), str(tmp_path / "customer"), out)["years"] == 1


def test_command_line(tmp_path):
    root = Path(__file__).parent.parent
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"lines_per_page": 2}))
    for _ in range(2):
        done = subprocess.run([sys.executable, "-m", "jobs.window_feed", f"{SF}/documents.parquet", str(tmp_path / "out"), str(tmp_path / "cp"), "--config", str(config)], cwd=root, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr
    assert "'batches': 0" in done.stderr and (tmp_path / "out" / "ledger").exists()


def test_check_counts_ids_in_one_pass(spark, monkeypatch):
    def joined(*_, **__):
        raise AssertionError("an end is joined")

    monkeypatch.setattr(type(spark.range(1)), "join", joined)
    nodes = spark.createDataFrame([(2020, "a"), (2020, "b"), (2021, "a")], "fiscal_year int, entity_id string")
    edges = lambda *rows: spark.createDataFrame(rows, "fiscal_year int, src string, tgt string")
    fiscal_graph.check(nodes, edges((2020, "a", "b"), (2021, "a", "a")))
    for n, e in ((nodes, edges((2021, "a", "b"))), (nodes, edges((2020, "a", None))), (nodes.union(nodes.limit(1)), edges((2020, "a", "b")))):
        with pytest.raises(ValueError, match="not written"):
            fiscal_graph.check(n, e)
