"""Loading resolved records into node and edge tables. A load makes a new snapshot; it never overwrites what it reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.properties import clean, merged, without_nulls
from .iteration import running_sum

#: Properties that lookups filter by, for the layout on disk.
LOOKUPS = {"Company": "name", "Metric": "name", "Person": "name", "Segment": "name", "Period": "fiscal_year"}


def remap(relationships: DataFrame, aliases: DataFrame) -> DataFrame:
    """Both ends through the aliases of the same document (by doc_ord, too, if aliases have it); an end without one stays
    as it is."""
    own = ["document_id", *(c for c in ("doc_ord",) if c in aliases.columns)]
    of = lambda c: aliases.select(*own, F.col("raw_id").alias(c), F.col("canonical_id").alias(f"new_{c}"))
    joined = relationships.join(of("source_id"), [*own, "source_id"], "left").join(of("target_id"), [*own, "target_id"], "left")
    ends = {c: F.coalesce(f"new_{c}", c) for c in ("source_id", "target_id")}
    return joined.withColumns(ends).select(relationships.columns)


def with_endpoints(relationships: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relationships both of whose ends are nodes of their own or an earlier document; the others are not loaded."""
    known = nodes.select(F.col("entity_id"), F.col("first_doc_ord"))
    a = known.select(F.col("entity_id").alias("source_id"), F.col("first_doc_ord").alias("a_ord"))
    b = known.select(F.col("entity_id").alias("target_id"), F.col("first_doc_ord").alias("b_ord"))
    early = (F.coalesce("a_ord", F.lit(0)) <= F.col("doc_ord")) & (F.coalesce("b_ord", F.lit(0)) <= F.col("doc_ord"))
    return relationships.join(a, "source_id").join(b, "target_id").filter(early).select(relationships.columns)


def dangling(relationships: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relationships of which an end is no node at all."""
    ids = nodes.select("entity_id")
    no_source = relationships.join(ids, F.col("source_id") == F.col("entity_id"), "left_anti")
    has_source = relationships.join(ids, F.col("source_id") == F.col("entity_id"), "left_semi")
    return no_source.unionByName(has_source.join(ids, F.col("target_id") == F.col("entity_id"), "left_anti"))


def _documents(sources: str) -> Column:
    """Document ids of a list of sources, in order and with repetitions."""
    return F.transform(F.col(sources), lambda s: s["document_id"])


def nodes_of(resolved: DataFrame) -> DataFrame:
    """Node rows of resolved entities, with clean properties."""
    kept = resolved.withColumn("properties", F.coalesce(clean("properties"), F.expr("map_from_arrays(CAST(array() AS array<string>), CAST(array() AS array<variant>))")))
    return kept.select("entity_id", "entity_type", F.array("entity_type").alias("labels"), "name", "properties", _documents("sources").alias("sources"), "first_doc_ord")


def edges_of(relationships: DataFrame) -> DataFrame:
    """One edge for each (source, type, target): properties last-wins without nulls, sources of the last record."""
    props = merged(relationships.withColumn("properties", clean("properties")), ["source_id", "type", "target_id"], last=("document_id",))
    return props.select(F.col("source_id").alias("src"), "type", F.col("target_id").alias("tgt"), without_nulls(F.col("properties")).alias("properties"), F.array("document_id").alias("sources"))


def edge_history(relationships: DataFrame) -> DataFrame:
    """The last record of each (source, type, target, filing year): what the edge table keeps of its last year alone."""
    from .extraction import year_key

    keyed = relationships.withColumn("filing_year", year_key())
    return keyed.groupBy("source_id", "type", "target_id", "filing_year").agg(F.max_by("document_id", "seq").alias("document_id"), F.count("*").alias("records"))


def over(old: Column, new: Column) -> Column:
    """One map over another: the new one's keys win."""
    kept = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k))
    return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(F.map_concat(kept, new))


def upsert_nodes(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Next snapshot of the nodes, by entity_id alone: properties are added over the old ones, labels accumulate,
    type, name and sources are the newest ones."""
    old, new = existing.alias("o"), incoming.alias("n")
    newer = lambda c: F.coalesce(f"n.{c}", f"o.{c}").alias(c)
    none = F.array().cast("array<string>")
    labels = F.array_union(F.coalesce("o.labels", none), F.coalesce("n.labels", none)).alias("labels")
    joined = old.join(new, F.col("o.entity_id") == F.col("n.entity_id"), "full_outer")
    return joined.select(newer("entity_id"), newer("entity_type"), labels, newer("name"), over(F.col("o.properties"), F.col("n.properties")).alias("properties"), newer("sources"), F.coalesce("o.first_doc_ord", "n.first_doc_ord").alias("first_doc_ord"))


def upsert_edges(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Next snapshot of the edges, by (src, type, tgt)."""
    old, new = existing.alias("o"), incoming.alias("n")
    newer = lambda c: F.coalesce(f"n.{c}", f"o.{c}").alias(c)
    same = [F.col(f"o.{c}") == F.col(f"n.{c}") for c in ("src", "type", "tgt")]
    joined = old.join(new, same, "full_outer")
    return joined.select(newer("src"), newer("type"), newer("tgt"), over(F.col("o.properties"), F.col("n.properties")).alias("properties"), newer("sources"))


def violations(table: DataFrame, *key: str) -> DataFrame:
    """Keys on more than one row; an empty result is the constraint."""
    return table.groupBy(*key).agg(F.count("*").alias("rows")).filter("rows > 1")


def lookup_key(nodes: DataFrame) -> Column:
    """What a node is looked up by, in lower case: the property that LOOKUPS names for its type (text or number), else
    its name. A node without it is never found by it."""
    key = F.lower("name")
    for kind, prop in LOOKUPS.items() if "properties" in nodes.columns else ():
        if prop != "name":
            value = F.try_variant_get(F.try_element_at("properties", F.lit(prop)), "$", "string")
            key = F.when(F.col("entity_type") == kind, F.lower(value)).otherwise(key)
    return key


def lookup(nodes: DataFrame, entity_type: str, value: str) -> DataFrame:
    """Nodes of a type whose looked-up property is the value, whatever the case: a number as it is written. On a snapshot
    read back this opens the type's folder alone, and of its files the row groups whose range holds the value."""
    key = F.col("lookup") if "lookup" in nodes.columns else lookup_key(nodes)
    return nodes.filter((F.col("entity_type") == entity_type) & (key == value.lower()))


def write_snapshot(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes by type and sorted by what they are looked up by, which becomes a column of its own, so that lookups prune
    folders and row groups; edges sorted by end. The path must be a new one."""
    laid = nodes.withColumns({"name_lc": F.lower("name"), "lookup": lookup_key(nodes)})
    order = ("entity_type", "lookup", "name_lc")
    laid.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("entity_type").parquet(f"{path}/nodes")
    edges.repartitionByRange("src", "tgt").sortWithinPartitions("src", "type").write.parquet(f"{path}/edges")


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def summary(assigned: DataFrame, aliases: DataFrame, relationships: DataFrame, written: DataFrame) -> DataFrame:
    """For each document: entities resolved so far, ids that stand for others, relationships attempted and those
    that became edges."""
    docs = assigned.groupBy("document_id").agg(F.min("doc_ord").alias("doc_ord"))
    first = assigned.groupBy("canonical_id").agg(F.min("doc_ord").alias("doc_ord")).groupBy("doc_ord").agg(F.count("*").alias("new"))
    so_far = running_sum(docs.join(first, "doc_ord", "left").withColumn("new", F.coalesce("new", F.lit(0))), "doc_ord", "new", "entities_resolved")
    remapped = aliases.groupBy("document_id").agg(F.count_if(F.col("raw_id") != F.col("canonical_id")).alias("ids_remapped"))
    tried = relationships.groupBy("document_id").agg(F.count("*").alias("attempted"))
    made = written.groupBy("document_id").agg(F.count("*").alias("written"))
    out = so_far.join(remapped, "document_id", "left").join(tried, "document_id", "left").join(made, "document_id", "left")
    return out.select("document_id", "doc_ord", "entities_resolved", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("ids_remapped", "attempted", "written")])
