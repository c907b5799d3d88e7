"""Incremental loading: new extraction files change the graph, once each.

Files come in the order of their names within a batch, after those of all earlier batches. A graph in a folder keeps,
beside nodes and edges, what later files must know of earlier ones: the entities as they were resolved (`state`) and the
files read (`files`). Each batch writes the rows that it changes, and no others, as one version; the newest version of a
key is what holds. So any number of batches give the same graph as one batch of all files.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from .. import schemas
from ..operators import extraction, loading, resolution
from ..operators.iteration import checkpoint, free, numbered
from ..sources import documents

#: Tables with their keys and schemas. Files are written last: their versions are the ones that are complete.
TABLES = {
    "nodes": (["entity_id"], schemas.NODES),
    "edges": (["src", "type", "tgt"], schemas.EDGES),
    "state": (["entity_id"], f"entity_id string, entity_type string, name string, properties {schemas.PROPERTIES}, sources array<{schemas.SOURCE}>, first_doc_ord long, seq long"),
    "files": (["file_path"], "file_path string, doc_ord long"),
}


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """Extraction results as they arrive; the checkpoint of the query knows which files were read."""
    found = spark.readStream.schema(schemas.EXTRACTION).option("multiLine", "true").option("pathGlobFilter", "*.json").json(path)
    return found.select("*", F.col("_metadata.file_path").alias("file_path"))


def event_counts(events: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events by window and type; events later than the watermark allows are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def closed_counts(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events(event_id, ts, event_type) by window and type, each event once, for append mode: a window's row comes once,
    when no event that counts can fall into it any more.

    An event that is `late` or more behind the newest one of all earlier batches is left out, and a repeat of an event
    that counts is, too. State holds the ids of the last `late` and the open windows, whatever the length of the stream.
    Events without a time count nowhere.
    """
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    counted = once.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n")


def append(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Add the closed rows of a stream to a Parquet table: each row once, also after a failure."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True)


class Graph:
    """Tables in a folder, as versions of their rows (a partition each).

    A version reads those before it and overwrites itself alone, so a batch that is run again writes the same rows again.
    """

    def __init__(self, path: str):
        self.path = path

    def _versions(self, spark: SparkSession, name: str, before: int) -> DataFrame:
        schema = f"{TABLES[name][1]}, version int"
        try:
            return spark.read.schema(schema).parquet(f"{self.path}/{name}").filter(F.col("version") < before)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], schema)

    def read(self, spark: SparkSession, before: int = (1 << 31) - 1) -> dict[str, DataFrame]:
        """The tables as they were before a version, without versions that were not finished."""
        done = self._versions(spark, "files", before).agg(F.max("version")).first()[0]
        out = {}
        for name, (key, schema) in TABLES.items():
            rows = self._versions(spark, name, -1 if done is None else done + 1)
            own = [c for c in rows.columns if c not in (*key, "version")]
            last = rows.groupBy(*key).agg(F.max_by(F.struct(*own), "version").alias("row"))
            out[name] = last.select(*[c if c in key else F.col(f"row.{c}").alias(c) for c in rows.columns if c != "version"])
        return out

    def write(self, version: int, changed: dict[str, DataFrame]) -> None:
        for name in TABLES:
            rows = changed[name].withColumn("version", F.lit(version))
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(f"{self.path}/{name}")


def _merged_state(old: DataFrame, assigned: DataFrame) -> DataFrame:
    """The entities that new records belong to: type, name and place of the first record, properties last-wins with nulls,
    sources."""
    first = assigned.groupBy(F.col("canonical_id").alias("entity_id")).agg(F.min("seq").alias("seq"))
    new = resolution.resolved(assigned).join(first, "entity_id").alias("n")
    joined = new.join(old.alias("o"), F.col("o.entity_id") == F.col("n.entity_id"), "left")
    none = F.array().cast(old.schema["sources"].dataType)
    made = {
        "sources": F.array_distinct(F.concat(F.coalesce("o.sources", none), F.coalesce(F.col("n.sources").cast(old.schema["sources"].dataType), none))),
        "properties": loading.over(F.col("o.properties"), F.col("n.properties")),
    }
    return joined.select(*[made.get(c, F.coalesce(f"o.{c}", f"n.{c}")).alias(c) for c in old.columns])


def changes(last: dict[str, DataFrame], results: DataFrame) -> dict[str, DataFrame]:
    """The rows that extraction results(document_id, entities, relationships, file_path) change, after those of `last`.

    Entities known before are leaders that come before all new records, which follow them or become leaders themselves,
    as if all had come at once. Each file is a document of its own, also if files share a document_id or have none. A
    file without results changes nothing but the list of files. A file's lists may be dealt over several rows with a
    `place` each (documents.records).
    """
    free(results.sparkSession)  # what the batch before has left
    read = last["files"].count()
    files = numbered(results, "file_path", "doc_ord").withColumn("doc_ord", F.col("doc_ord") + read)
    found = checkpoint(results.withColumn("document_id", F.coalesce("document_id", F.lit("unknown"))).join(files, "file_path"))
    entities, relationships = documents.records(found)
    records = resolution.with_names(extraction.merge_entities(entities.withColumn("type", F.coalesce("type", F.lit("")))))
    known = last["state"].select(F.col("entity_id").alias("id"), F.col("entity_type").alias("type"), "name", "seq")
    assigned = checkpoint(resolution.assign(records, known=known))
    free(results.sparkSession)
    state = checkpoint(_merged_state(last["state"], assigned))
    nodes = loading.nodes_of(state)
    places = last["state"].select("entity_id", "first_doc_ord").join(state.select("entity_id"), "entity_id", "left_anti").unionByName(state.select("entity_id", "first_doc_ord"))
    linked = extraction.dedup_relationships(relationships.withColumn("type", F.coalesce("type", F.lit(""))))
    new = checkpoint(loading.edges_of(loading.with_endpoints(loading.remap(linked, resolution.alias(assigned)), places)))
    edges = loading.upsert_edges(last["edges"].join(new.select("src", "type", "tgt"), ["src", "type", "tgt"], "left_semi").select(last["edges"].columns), new)
    return {"nodes": nodes, "edges": edges, "state": state, "files": files}


def load(stream: DataFrame, graph: Graph, checkpoint: str) -> DataStreamWriter:
    """Write what each batch of extraction results changes as the next version of a graph."""

    def batch(results: DataFrame, version: int) -> None:
        graph.write(version, changes(graph.read(results.sparkSession, version), results))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True)
