"""A graph from relational tables: regions, nations, customers, suppliers and parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import PROPERTIES

ID = {"region": "region_", "nation": "nation_", "customer": "company_", "supplier": "legal_", "part": "product_"}
_NODES = (
    ("region", "r_regionkey", "r_name", "Geography"),
    ("nation", "n_nationkey", "n_name", "Geography"),
    ("customer", "c_custkey", "c_name", "Company"),
    ("supplier", "s_suppkey", "s_name", "LegalEntity"),
    ("part", "p_partkey", "p_name", "Product"),
)
PARTITION_ROWS = 1_250_000  # line items in a partition: about 250 MB where they are made distinct


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def key(table: str, column: str) -> Column:
    return F.concat(F.lit(ID[table]), F.col(column).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, entity_type, name). The type is a literal of each branch, so a filter on it drops the others."""
    parts = [read(spark, sf_dir, t).select(key(t, k).alias("entity_id"), F.lit(kind).alias("entity_type"), F.col(n).alias("name")) for t, k, n, kind in _NODES]
    return reduce(DataFrame.unionByName, parts)


def edge_partitions(spark: SparkSession, sf_dir: str) -> int | None:
    """Into how many partitions edges are dealt, so that a task has no more of them where the tables grow: the session's
    number at least; None where one partition could hold them all, which Spark deals by itself. Only Parquet's footers are read."""
    n = -(-read(spark, sf_dir, "lineitem").count() // PARTITION_ROWS)
    return max(n, int(spark.conf.get("spark.sql.shuffle.partitions"))) if n > 1 else None


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, type, tgt), each once."""
    of = lambda table, src, kind, tgt: read(spark, sf_dir, table).select(src.alias("src"), F.lit(kind).alias("type"), tgt.alias("tgt"))
    supplied = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")  # numbers are a fraction of their ids
    if n := edge_partitions(spark, sf_dir):
        supplied = supplied.repartition(n, "l_suppkey", "l_partkey")  # dealt first, so that no task has a hash table of a whole split
    supplied = supplied.distinct()
    parts = [
        of("nation", key("nation", "n_nationkey"), "RELATED_TO", key("region", "n_regionkey")),
        of("customer", key("customer", "c_custkey"), "OPERATES_IN", key("nation", "c_nationkey")),
        of("supplier", key("supplier", "s_suppkey"), "OPERATES_IN", key("nation", "s_nationkey")),
        supplied.select(key("supplier", "l_suppkey").alias("src"), F.lit("HAS_SEGMENT").alias("type"), key("part", "l_partkey").alias("tgt")),
    ]
    return reduce(DataFrame.unionByName, parts)


def supply_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relationship records with repeats: one for each line item, in the order of order and line, with its year."""
    # Order and line do not tell all items apart; day and quantity do.
    seq = ((F.col("l_orderkey") * 16 + F.col("l_linenumber")) * 6400000 + F.date_diff("l_shipdate", F.lit("1970-01-01").cast("date")) * 64 + F.col("l_quantity").cast("long")).cast("long")
    year = F.year("l_shipdate")
    return read(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("filing_"), year.cast("string")).alias("document_id"),
        key("supplier", "l_suppkey").alias("source_id"),
        F.lit("HAS_SEGMENT").alias("type"),
        key("part", "l_partkey").alias("target_id"),
        F.expr("from_json(to_json(named_struct('filing_year', year(l_shipdate), 'quantity', l_quantity)), 'map<string,variant>')").alias("properties"),
        seq.alias("seq"),
    )


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ordered log of property bags: each event is a record of its user, with the event's type beside its JSON."""
    bag = F.expr("from_json(props, 'map<string,variant>')")
    own = F.expr("from_json(to_json(named_struct('event_type', event_type, 'value', value)), 'map<string,variant>')")
    return read(spark, sf_dir, "events").select(
        F.lit("events").alias("document_id"),
        F.concat(F.lit("person_"), F.col("user_id").cast("string")).alias("id"),
        F.lit("Person").alias("type"),
        F.map_concat(own, bag).alias("properties"),
        F.col("event_id").alias("seq"),
        F.lit(0).cast("long").alias("doc_ord"),
        F.struct(F.lit("events").alias("document_id"), F.dayofmonth("ts").alias("page_num"), F.col("event_type").alias("section")).alias("source"),
    )


def name_records(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Entity records of a table's rows, in the order of their keys."""
    _, k, n, kind = next(x for x in _NODES if x[0] == table)
    return read(spark, sf_dir, table).select(
        F.lit("tables").alias("document_id"),
        F.lit(0).cast("long").alias("doc_ord"),
        F.col(k).cast("long").alias("seq"),
        key(table, k).alias("id"),
        F.lit(kind).alias("type"),
        F.col(n).alias("name"),
    )


def event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction results as files would hold them, one for each hour of the events, in the order of their names: users and
    event types as entities, and what a user did as a relationship. A file's lists are dealt over rows of one event each, so
    that no row grows with its file; `place` is where a row's lists begin (documents.records)."""
    e = read(spark, sf_dir, "events")
    hour = F.concat(F.lit("events_"), F.date_format(F.date_trunc("hour", F.col("ts").cast("timestamp")), "yyyyMMddHH"))
    source = F.struct(F.lit(None).cast("string").alias("document_id"), F.dayofmonth("ts").alias("page_num"), F.col("event_type").alias("section"))
    bag = lambda **p: F.from_json(F.to_json(F.struct(*[v.alias(k) for k, v in p.items()])), PROPERTIES)
    person, kind = F.concat(F.lit("person_"), F.col("user_id").cast("string")), F.concat(F.lit("event_"), "event_type")
    entity = lambda key, t, p: F.struct(key.alias("id"), F.lit(t).alias("type"), p.alias("properties"), source.alias("source"))
    user = entity(person, "Person", bag(name=F.md5(F.col("user_id").cast("string")), event_type=F.col("event_type"), value=F.col("value")))
    did = F.struct(person.alias("source_id"), kind.alias("target_id"), F.lit("RELATED_TO").alias("type"), bag(event_id=F.col("event_id")).alias("properties"), source.alias("source"))
    nth = F.row_number().over(Window.partitionBy("file_path").orderBy("event_id")).cast("long") - 1
    rows = e.withColumn("file_path", hour).withColumn("nth", nth)
    return rows.select("file_path", F.col("file_path").alias("document_id"), (F.col("nth") * 2).alias("place"), F.array(user, entity(kind, "Event", bag(name=F.col("event_type")))).alias("entities"), F.array(did).alias("relationships"))
