"""The jobs as queries: each runs twice over the whole tables into one new folder, and returns the output as it stands."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.iteration import shared_dir
from loomgraph.queries import ORACLES as GRAPH_ORACLES

from . import fiscal_graph, window_feed
from .common import table


def _folder(spark: SparkSession, job: str) -> str:
    return f"{shared_dir(spark)}/jobs/{job}-{uuid.uuid4().hex}"


def job1_window_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark, "window_feed")
    for _ in range(2):
        window_feed.run(spark, f"{sf_dir}/documents.parquet", f"{at}/out", f"{at}/checkpoint")
    made, entry = table(spark, f"{at}/out/windows", window_feed.WINDOWS), table(spark, f"{at}/out/ledger", window_feed.LEDGER)
    cut = made.select("document_id", "lang", "window_idx", "page_range", "chars", F.md5("page_content").alias("content_md5"))  # the texts are not moved
    return entry.select("document_id", "source", F.col("windows").alias("n_windows"), "status").join(cut, "document_id", "left")


def job2_fiscal_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark, "fiscal_graph")
    for _ in range(2):
        fiscal_graph.run(spark, f"{sf_dir}/orders.parquet", f"{sf_dir}/customer.parquet", f"{at}/out")
    nodes, edges = table(spark, f"{at}/out/nodes", fiscal_graph.NODES), table(spark, f"{at}/out/edges", fiscal_graph.EDGES)
    none = F.lit(None).cast("string")
    a = nodes.select(F.lit("node").alias("kind"), "fiscal_year", F.col("entity_type").alias("type"), F.col("entity_id").alias("id"), none.alias("target"), "name", F.col("amount").cast("string").alias("amount"), "currency", "unit")
    b = edges.select(F.lit("edge").alias("kind"), "fiscal_year", "type", F.col("src").alias("id"), F.col("tgt").alias("target"), F.col("source").alias("name"), none.alias("amount"), none.alias("currency"), none.alias("unit"))
    return a.unionByName(b)


QUERIES = {f.__name__: f for f in (job1_window_feed, job2_fiscal_graph)}
ORACLES = {
    "job1_window_feed": f"""WITH w AS ({GRAPH_ORACLES["window_text"]}), n AS (SELECT document_id, count(*) AS n FROM w GROUP BY 1)
  SELECT 'document_' || d.doc_id AS document_id, d.source, coalesce(n.n, 0) AS n_windows, CASE WHEN n.n > 0 THEN 'windowed' ELSE 'empty' END AS status, CASE WHEN n.n > 0 THEN coalesce(d.lang, 'und') END AS lang,
    w.window_idx, w.page_range, CAST(length(w.page_content) AS INTEGER) AS chars, md5(w.page_content) AS content_md5
  FROM documents d LEFT JOIN n ON n.document_id = 'document_' || d.doc_id LEFT JOIN w ON w.document_id = 'document_' || d.doc_id""",
    "job2_fiscal_graph": """WITH o AS (SELECT year(o_orderdate) AS y, 'company_' || c_custkey AS company, c_name, CAST(o_totalprice AS DECIMAL(20,2)) AS price, o_orderstatus AS s FROM orders JOIN customer ON c_custkey = o_custkey),
  f AS (SELECT y, company, c_name, CAST(sum(price) AS DECIMAL(20,2)) AS order_value, CAST(count(*) AS DECIMAL(20,2)) AS orders, CAST(count(*) FILTER (WHERE s = 'O') AS DECIMAL(20,2)) AS open_orders FROM o GROUP BY ALL),
  v AS (SELECT y, company, c_name, 'order_value' AS metric, order_value AS amount, 'USD' AS currency, 'units' AS unit FROM f
    UNION ALL SELECT y, company, c_name, 'orders', orders, NULL, 'orders' FROM f UNION ALL SELECT y, company, c_name, 'open_orders', open_orders, NULL, 'orders' FROM f),
  k AS (SELECT *, 'metricvalue_' || metric || '_' || company || '_' || y AS value FROM v)
  SELECT DISTINCT 'node' AS kind, CAST(y AS INTEGER) AS fiscal_year, 'Company' AS type, company AS id, CAST(NULL AS VARCHAR) AS target, c_name AS name, CAST(NULL AS VARCHAR) AS amount, CAST(NULL AS VARCHAR) AS currency, CAST(NULL AS VARCHAR) AS unit FROM k
  UNION ALL SELECT DISTINCT 'node', CAST(y AS INTEGER), 'Metric', 'metric_' || metric, NULL, metric, NULL, NULL, NULL FROM k
  UNION ALL SELECT DISTINCT 'node', CAST(y AS INTEGER), 'Period', 'period_fy' || y, NULL, 'FY' || y, NULL, NULL, NULL FROM k
  UNION ALL SELECT 'node', CAST(y AS INTEGER), 'MetricValue', value, NULL, value, CAST(amount AS VARCHAR), currency, unit FROM k
  UNION ALL SELECT DISTINCT 'edge', CAST(y AS INTEGER), 'REPORTS', company, 'metric_' || metric, 'orders_' || y, NULL, NULL, NULL FROM k
  UNION ALL SELECT 'edge', CAST(y AS INTEGER), 'HAS_VALUE', 'metric_' || metric, value, 'orders_' || y, NULL, NULL, NULL FROM k
  UNION ALL SELECT 'edge', CAST(y AS INTEGER), 'IN_PERIOD', value, 'period_fy' || y, 'orders_' || y, NULL, NULL, NULL FROM k""",
}
