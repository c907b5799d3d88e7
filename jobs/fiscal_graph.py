"""A graph of companies' figures by fiscal year, kept up to date by year.

    python -m jobs.fiscal_graph ORDERS CUSTOMERS OUT [--config jobs/fiscal_graph.json]

ORDERS and CUSTOMERS are Parquet tables. A company's orders of a year give one value for each metric. Each run compares
every year of the orders with the ledger of what was read of it before, and writes the years that differ:

    OUT/nodes   entity_id, entity_type, name, amount, currency, unit; partitioned by fiscal_year and entity_type
    OUT/edges   src, tgt, source; partitioned by fiscal_year and type
    OUT/ledger  orders, companies, fingerprint; partitioned by fiscal_year

The graph is the ontology's: a company REPORTS a metric, a metric HAS_VALUE a metric value, which is IN_PERIOD a period.
Nodes have unique ids, and edges end at nodes, or the year is not written: the job fails before it touches the output.
A year's partitions are replaced as a whole and the ledger is written last, so a run that failed is done again with the
same result. The fingerprint of a year covers all columns that are read of its orders and of their customers, and the
settings. Orders of unknown customers, and those without a customer or a date, are counted in the log and left out. A
year all of whose orders are gone from the source keeps its last state.
"""

from __future__ import annotations

import json
import logging
import os
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import ontology
from loomgraph.functions.text import entity_slug
from loomgraph.operators.iteration import checkpoint
from loomgraph.sources import tables

from .common import command, overwrite, settings, table

log = logging.getLogger(__name__)
#: Metrics as aggregates over a company's orders of a year, with currency and unit.
METRICS = {
    "order_value": ("sum(price)", "USD", "units"),
    "orders": ("count(*)", None, "orders"),
    "open_orders": ("count_if(status = 'O')", None, "orders"),
}
DEFAULTS = {"metrics": list(METRICS), "years": None}
NODES = "entity_id string, name string, amount decimal(20,2), currency string, unit string, fiscal_year int, entity_type string"
EDGES = "src string, tgt string, source string, fiscal_year int, type string"
LEDGER = "orders long, companies long, fingerprint decimal(38,0), fiscal_year int"


def purchases(orders: DataFrame, customers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fiscal_year, company, company_name, price, status, mark) of orders with a known customer and a date, and the
    other orders."""
    found = orders.select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("fiscal_year"), F.col("o_totalprice").cast("decimal(20,2)").alias("price"), F.col("o_orderstatus").alias("status"))
    known = customers.groupBy("c_custkey").agg(F.min("c_name").alias("company_name")).withColumn("company", tables.key("customer", "c_custkey"))
    joined = found.join(known, F.col("o_custkey") == F.col("c_custkey"), "left")
    good = F.col("company").isNotNull() & F.col("fiscal_year").isNotNull()
    mark = F.xxhash64("o_orderkey", "company", "company_name", "fiscal_year", "price", "status")
    return joined.filter(good).select("fiscal_year", "company", "company_name", "price", "status", mark.alias("mark")), joined.filter(~good)


def ledger(bought: DataFrame, config: dict[str, Any]) -> DataFrame:
    """One row for each year: what its orders are, in any order of rows."""
    own = F.xxhash64(F.lit(json.dumps(sorted(config["metrics"])))).cast("decimal(38,0)")
    return bought.groupBy("fiscal_year").agg(F.count("*").alias("orders"), F.count_distinct("company").alias("companies"), (F.sum(F.col("mark").cast("decimal(20,0)")) + own).cast("decimal(38,0)").alias("fingerprint"))


def values(bought: DataFrame, metrics: list[str]) -> DataFrame:
    """(fiscal_year, company, company_name, metric, amount, currency, unit)."""
    facts = bought.groupBy("fiscal_year", "company", "company_name").agg(*[F.expr(METRICS[m][0]).alias(m) for m in metrics])
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("decimal(20,2)").alias("amount"), F.lit(METRICS[m][1]).cast("string").alias("currency"), F.lit(METRICS[m][2]).alias("unit")) for m in metrics])
    return facts.select("fiscal_year", "company", "company_name", F.inline(each))


def graph(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of values, with the year that each is of."""
    metric, period = entity_slug(F.lit("Metric"), F.col("metric")), entity_slug(F.lit("Period"), F.concat(F.lit("fy"), "fiscal_year"))
    value = F.concat(F.lit("metricvalue_"), "metric", F.lit("_"), "company", F.lit("_"), "fiscal_year")
    none = F.lit(None).cast("string")

    def nodes(kind: str, key: Column, name: Column, amount: Column = none, currency: Column = none, unit: Column = none) -> DataFrame:
        made = found.select(key.alias("entity_id"), F.lit(kind).alias("entity_type"), name.alias("name"), amount.cast("decimal(20,2)").alias("amount"), currency.alias("currency"), unit.alias("unit"), "fiscal_year")
        return made if kind == "MetricValue" else made.distinct()

    def edges(a: Column, kind: str, b: Column) -> DataFrame:
        made = found.select(a.alias("src"), F.lit(kind).alias("type"), b.alias("tgt"), F.concat(F.lit("orders_"), "fiscal_year").alias("source"), "fiscal_year")
        return made if kind == "IN_PERIOD" else made.distinct()

    every = [
        nodes("Company", F.col("company"), F.col("company_name")),
        nodes("Metric", metric, F.col("metric")),
        nodes("Period", period, F.concat(F.lit("FY"), "fiscal_year")),
        nodes("MetricValue", value, value, F.col("amount"), F.col("currency"), F.col("unit")),
    ]
    linked = [edges(F.col("company"), "REPORTS", metric), edges(metric, "HAS_VALUE", value), edges(value, "IN_PERIOD", period)]
    return ontology.valid(reduce(DataFrame.unionByName, every), column="entity_type"), ontology.valid(reduce(DataFrame.unionByName, linked), "relationship")


def check(nodes: DataFrame, edges: DataFrame) -> None:
    """Raise ValueError unless ids are unique in a year and all edges end at nodes of theirs."""
    ends = edges.select("fiscal_year", F.explode(F.array("src", "tgt")).alias("id"), F.lit(0).alias("n"))
    # One pass over all ids instead of a join for each end.
    each = nodes.select("fiscal_year", F.col("entity_id").alias("id"), F.lit(1).alias("n")).unionByName(ends).groupBy("fiscal_year", "id").agg(F.sum("n").alias("nodes"))
    bad = each.filter("nodes <> 1").limit(6).collect()
    twice, loose = [r for r in bad if r.nodes], [r for r in bad if not r.nodes]
    if twice or loose:
        raise ValueError(f"the graph is not written: repeated ids {twice}, edges without ends {loose}")


def run(spark: SparkSession, orders: str, customers: str, out: str, config: dict[str, Any] | None = None) -> dict[str, int]:
    """Write the years that differ from the ledger; returns what was read and written."""
    config = settings(config, DEFAULTS)
    if not config["metrics"] or set(config["metrics"]) - set(METRICS):
        raise ValueError(f"metrics must be some of {', '.join(METRICS)}")
    bought, strange = purchases(spark.read.parquet(orders), spark.read.parquet(customers))
    if config["years"] is not None:
        bought = bought.filter(F.col("fiscal_year").isin(config["years"]))
    now, before = ledger(bought, config), table(spark, f"{out}/ledger", LEDGER)
    seen = before.select("fiscal_year", F.col("fingerprint").alias("f"), F.col("orders").alias("o"))
    # A row for each year, so the years that differ are a short list.
    stale = now.join(seen, "fiscal_year", "left").filter("f IS NULL OR f <> fingerprint OR o <> orders").orderBy("fiscal_year").collect()
    log.info("read %s and %s: %d orders left out, years to write: %s", orders, customers, strange.count(), [r.fiscal_year for r in stale])
    if not stale:
        return {"years": 0, "orders": 0, "nodes": 0, "edges": 0}
    years = [r.fiscal_year for r in stale]
    # The figures are few beside the orders; checks and writers read them from the shared folder.
    nodes, edges = graph(checkpoint(values(bought.filter(F.col("fiscal_year").isin(years)), config["metrics"])))
    check(nodes, edges)
    overwrite(nodes, f"{out}/nodes", "fiscal_year", "entity_type")
    overwrite(edges, f"{out}/edges", "fiscal_year", "type")
    overwrite(spark.createDataFrame(stale, now.join(seen, "fiscal_year", "left").schema).select("orders", "companies", "fingerprint", "fiscal_year"), f"{out}/ledger", "fiscal_year")
    wrote = {k: table(spark, f"{out}/{k}", s).filter(F.col("fiscal_year").isin(years)).count() for k, s in (("nodes", NODES), ("edges", EDGES))}
    done = {"years": len(years), "orders": sum(r.orders for r in stale), **wrote}
    log.info("wrote %d years of %d orders: %d nodes, %d edges to %s", *done.values(), out)
    return done


if __name__ == "__main__":
    raise SystemExit(command(run, __doc__, ("orders", "customers", "out"), f"{os.path.dirname(os.path.abspath(__file__))}/fiscal_graph.json"))
