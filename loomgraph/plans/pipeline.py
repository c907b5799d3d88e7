"""From a folder of filings to a graph: parse, extract and load what is new, with a status for each filing."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import extraction, windows
from ..operators.extraction import Extractor
from ..operators.iteration import checkpoint
from ..sources import documents, filings
from ..streaming import incremental
from . import build
from .session import Settings

log = logging.getLogger(__name__)
#: Reads one binary file: (path, content) -> (page_idx, page_number, block_pos, block_type, block_order, content) rows.
Parser = Callable[[str, bytes], list[tuple]]


def _done(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """(document_id) of the JSON documents in a folder; none where there is no folder yet."""
    try:
        found = spark.read.schema(schema).option("multiLine", "true").option("pathGlobFilter", "*.json").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], schema)
    return found.select(F.col(key).alias("document_id")).filter("document_id IS NOT NULL").distinct()


def parse(spark: SparkSession, found: DataFrame, settings: Settings, parser: Parser) -> None:
    """Parse filings(document_id, path, document_name) into the folder of parsed documents. Files are read where they are
    parsed, and a file that the parser cannot read has no document."""

    def careful(path: str, content: bytes) -> list[tuple]:
        try:
            return parser(path, content)
        except Exception:  # noqa: BLE001  one file's failure is its status, not the job's end
            return []

    binary = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").load(settings.raw).select("path", "content")
    blocks = documents.parsed_with(found.select("document_id", "path").join(binary, "path"), careful)
    headers = found.select("document_id", F.col("document_name").alias("name"), F.lit("pdf").alias("format"), F.col("path").alias("file_path"))
    documents.write_json(documents.tree(blocks, headers), settings.parsed, "id")


def extract(spark: SparkSession, ids: DataFrame, settings: Settings, extractor: Extractor, throttle: tuple[int, float] | None = None) -> None:
    """Extract from the parsed documents with these ids into the folder of extraction results. A document's windows are
    read in order; calls are made once, as their answers are checkpointed."""
    blocks = documents.blocks_of_tree(documents.read_parsed(spark, settings.parsed).join(ids.select(F.col("document_id").alias("id")), "id", "left_semi"))
    answers = checkpoint(extraction.responses(windows.texts(blocks), extractor, throttle))
    entities, relationships, errors = extraction.parsed(answers)
    listed = lambda df, name, *fields: df.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.struct(*fields).alias("row")))), lambda x: x["row"]).alias(name))
    text = lambda df: df.withColumn("properties", F.to_json("properties"))  # noqa: E731  open maps have no order; their JSON has
    e = listed(text(extraction.merge_entities(entities)), "entities", "id", "type", "properties", "source")
    r = listed(text(extraction.dedup_relationships(relationships)), "relationships", "source_id", "target_id", "type", "properties", "source")
    wrong = errors.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("pages", "message"))).alias("errors"))
    every = answers.select("document_id").distinct().join(e, "document_id", "left").join(r, "document_id", "left").join(wrong, "document_id", "left")
    open_ = lambda c: F.transform(c, lambda x: x.withField("properties", F.from_json(x["properties"], schemas.PROPERTIES)))
    documents.write_json(every.withColumns({"entities": open_("entities"), "relationships": open_("relationships")}), settings.extracted, "document_id")


def run(spark: SparkSession, settings: Settings, parser: Parser, extractor: Extractor, company: str | None = None, force: bool = False, throttle: tuple[int, float] | None = None) -> DataFrame:
    """Bring the graph up to date with the filings; returns (document_id, stage, status) of each filing and stage.

    Filings with a parsed document are not parsed again, parsed ones with a result are not read by the extractor again,
    and results that the graph has are not loaded again; `force` does the first two anew, and what they give is loaded
    after the rest. Filings that share an id are one document, by the first path.
    """
    found = checkpoint(filings.discover(spark, settings.raw, company).groupBy("document_id").agg(F.min(F.struct("path", "document_name")).alias("f")).select("document_id", "f.*"))
    have = lambda path, schema, key: _done(spark, path, schema, key)
    todo = checkpoint(filings.pending(found, have(settings.parsed, schemas.PARSED, "id"), force))
    if not todo.isEmpty():
        parse(spark, todo, settings, parser)
    parsed = checkpoint(have(settings.parsed, schemas.PARSED, "id").join(found, "document_id", "left_semi"))
    waiting = checkpoint(filings.pending(parsed, have(settings.extracted, schemas.EXTRACTION, "document_id"), force))
    if not waiting.isEmpty():
        extract(spark, waiting, settings, extractor, throttle)
    extracted = checkpoint(have(settings.extracted, schemas.EXTRACTION, "document_id").join(found, "document_id", "left_semi"))
    graph = incremental.Graph(settings.graph)
    if not extracted.isEmpty():
        incremental.load(incremental.read_stream(spark, settings.extracted), graph, f"{settings.graph}/_checkpoint").start().awaitTermination()
    loaded = graph.read(spark)["files"].select(F.regexp_extract(F.url_decode("file_path"), "_key=([^/]*)/", 1).alias("document_id")).distinct()
    ok = lambda df: df.select("document_id", F.lit(True).alias("ok"))
    states = build.status(found, {"parse": ok(parsed), "extract": ok(extracted), "load": ok(loaded)})
    log.info("%d filings: %d parsed and %d extracted now", found.count(), todo.count(), waiting.count())
    return states
