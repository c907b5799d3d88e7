"""Asking the graph: name search, expansion by one or two hops, and what it holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEARCH_LIMIT, PATH_LIMIT, ROW_LIMIT, MOST_DEPTH = 20, 50, 50, 2


def _lower_name(nodes: DataFrame) -> Column:
    """The stored lower-case name, which Parquet can filter by; else the name lower-cased."""
    return F.col("name_lc") if "name_lc" in nodes.columns else F.lower("name")


def search(nodes: DataFrame, query: str, entity_type: str | None = None, limit: int | None = SEARCH_LIMIT) -> DataFrame:
    """Nodes whose name holds the query, whatever the case. % and _ stand for themselves; an empty query finds
    every named node. Results are in the order of entity_id, so a limit always gives the same ones."""
    kept = nodes if entity_type is None else nodes.filter(F.array_contains("labels", entity_type) if "labels" in nodes.columns else F.col("entity_type") == entity_type)
    found = kept.filter(F.col("name").isNotNull() & F.contains(_lower_name(nodes), F.lit(query.lower())))
    return found if limit is None else found.orderBy("entity_id").limit(limit)


#: What tells edges apart; other columns of an edge are carried along.
EDGE = ("src", "type", "tgt")


def incident(edges: DataFrame) -> DataFrame:
    """(here, there, and the edge's columns): each edge from both of its ends; a loop once."""
    out = edges.select(F.col("src").alias("here"), F.col("tgt").alias("there"), *edges.columns)
    back = edges.filter("src <> tgt").select(F.col("tgt").alias("here"), F.col("src").alias("there"), *edges.columns)
    return out.unionByName(back)


def paths(edges: DataFrame, start: DataFrame, depth: int = 1, rel_type: str | None = None) -> DataFrame:
    """Undirected paths of 1 to `depth` (2 at most) edges from start(entity_id), each edge at most once in a path.

    Returns start_id, depth, mid_id (null at depth 1), end_id and hops (array of src, type, tgt and all other
    columns of the edges, such as properties and sources). rel_type holds for every hop. Filters on the start
    reach both scans of the edges.
    """
    if depth < 1:
        raise ValueError("depth must be 1 at least")
    kept = edges if rel_type is None else edges.filter(F.col("type") == rel_type)
    each = incident(kept)
    hop = F.struct(*EDGE, *[c for c in edges.columns if c not in EDGE])
    same = [F.col(f"first.{c}") == F.col(f"second.{c}") for c in EDGE]
    one = start.select(F.col("entity_id").alias("start_id")).join(each, F.col("start_id") == F.col("here")).select("start_id", F.col("there").alias("end_id"), hop.alias("first"))
    at_one = one.select("start_id", F.lit(1).alias("depth"), F.lit(None).cast("string").alias("mid_id"), "end_id", F.array("first").alias("hops"))
    if min(depth, MOST_DEPTH) == 1:
        return at_one
    second = each.select("here", F.col("there").alias("last"), hop.alias("second"))
    two = one.join(second, F.col("end_id") == F.col("here")).filter(~(same[0] & same[1] & same[2]))
    return at_one.unionByName(two.select("start_id", F.lit(2).alias("depth"), F.col("end_id").alias("mid_id"), F.col("last").alias("end_id"), F.array("first", "second").alias("hops")))


def neighbors(edges: DataFrame, entity_id: str, depth: int = 1, rel_type: str | None = None, limit: int | None = PATH_LIMIT) -> DataFrame:
    """Paths from one node, in a fixed order; the limit counts paths. Shorter paths come first, so the second hop is not
    looked at where the first one fills the limit."""
    start = edges.sparkSession.range(1).select(F.lit(entity_id).alias("entity_id"))
    if limit is not None and depth > 1 and paths(edges, start, 1, rel_type).limit(limit).count() == limit:
        depth = 1
    found = paths(edges, start, depth, rel_type)
    return found if limit is None else found.orderBy("depth", "end_id", F.col("mid_id").asc_nulls_first(), F.to_json(F.transform("hops", lambda h: F.struct(*[h[c].alias(c) for c in EDGE])))).limit(limit)


def nodes_on(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes of paths, each once, with the least depth at which it stands (0: the start)."""
    ends = F.array(F.struct(F.lit(0).alias("depth"), F.col("start_id").alias("entity_id")), F.struct(F.lit(1).alias("depth"), F.col("mid_id").alias("entity_id")), F.struct("depth", F.col("end_id").alias("entity_id")))
    seen = found.select(F.explode(ends).alias("x")).filter("x.entity_id IS NOT NULL").groupBy("x.entity_id").agg(F.min("x.depth").alias("depth"))
    return nodes.join(seen, "entity_id")


def edges_on(found: DataFrame) -> DataFrame:
    """The edges of paths, each once, with all their columns."""
    each = found.select(F.explode("hops").alias("h")).select("h.*")
    rest = [F.first(c).alias(c) for c in each.columns if c not in EDGE]
    return each.groupBy(*EDGE).agg(*rest) if rest else each.distinct()


def node_counts(nodes: DataFrame) -> DataFrame:
    """Nodes by their first label, the most frequent first."""
    label = F.get("labels", F.lit(0)) if "labels" in nodes.columns else F.col("entity_type")
    return nodes.groupBy(label.alias("label")).agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "label")


def edge_counts(edges: DataFrame) -> DataFrame:
    """Edges by type, the most frequent first."""
    return edges.groupBy("type").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "type")


def schema_summary(nodes: DataFrame, edges: DataFrame) -> str:
    """What the graph holds, as text. The vocabulary is closed, so few rows reach the driver."""
    lines = ["Node counts:", *[f"  {r.label}: {r.cnt}" for r in node_counts(nodes).collect()]]
    return "\n".join([*lines, "Relationship counts:", *[f"  {r.type}: {r.cnt}" for r in edge_counts(edges).collect()]])


#: Columns that are of use to the engine alone, and those that a compact node leaves out besides.
BOOKKEEPING, LONG = ("first_doc_ord", "name_lc", "lookup", "depth"), ("sources", "labels")


def full(nodes: DataFrame) -> DataFrame:
    """Nodes once each with their sources, as evidence keeps them."""
    return nodes.dropDuplicates(["entity_id"]).drop(*BOOKKEEPING)


def compact(nodes: DataFrame) -> DataFrame:
    """Nodes once each, without bookkeeping; a property called type stays apart from the entity's type."""
    return full(nodes).drop(*LONG)
