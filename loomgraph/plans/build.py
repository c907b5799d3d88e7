"""From filings to a graph: stages over all documents at once, with a status for each filing and stage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import extraction, loading, resolution, windows
from ..operators.extraction import Extractor
from ..operators.iteration import checkpoint, numbered


@dataclass
class Built:
    nodes: DataFrame
    edges: DataFrame
    edge_history: DataFrame
    errors: DataFrame
    summary: DataFrame
    aliases: DataFrame


def graph_of(entities: DataFrame, relationships: DataFrame, errors: DataFrame, strict: bool = False) -> Built:
    """Resolve and load entity and relationship records of all documents, as one run over the ordered log."""
    merged = extraction.merge_entities(entities)
    linked = extraction.dedup_relationships(relationships)
    assigned = resolution.assign(resolution.with_names(merged), strict=strict)
    aliases = resolution.alias(assigned)
    nodes = loading.nodes_of(resolution.resolved(assigned))
    mapped = loading.remap(linked, aliases)
    written = loading.with_endpoints(mapped, nodes)
    return Built(nodes, loading.edges_of(written), loading.edge_history(written), errors, loading.summary(assigned, aliases, mapped, written), aliases)


def build(blocks: DataFrame, extractor: Extractor, order: DataFrame | None = None, throttle: tuple[int, float] | None = None, strict: bool = False) -> Built:
    """Build a graph from blocks. order: (document_id, doc_ord); without it documents come in the order of their ids.

    The extractor's answers are checkpointed: what follows reads them several times, and a call is never repeated
    for it.
    """
    texts = windows.texts(blocks)
    answers = checkpoint(extraction.responses(texts, extractor, throttle))
    if order is None:
        order = numbered(blocks, "document_id", "doc_ord")
    return graph_of(*extraction.parsed(answers.join(order, "document_id")), strict=strict)


def status(filings: DataFrame, stages: dict[str, DataFrame]) -> DataFrame:
    """(document_id, stage, status) for each filing and stage; stages: name -> (document_id, ok)."""
    out = None
    for name, done in stages.items():
        own = filings.select("document_id").join(done, "document_id", "left").select("document_id", F.lit(name).alias("stage"), F.when(F.col("ok"), "ok").when(~F.col("ok"), "failed").otherwise("missing").alias("status"))
        out = own if out is None else out.unionByName(own)
    return out


def fully_processed(states: DataFrame, strict: bool = False) -> DataFrame:
    """(filings, processed): filings all of whose recorded stages are ok. A stage that never ran counts only in
    strict mode."""
    fine = F.col("status") == "ok"
    if not strict:
        fine = F.when(F.col("status") != "missing", fine)  # nulls do not count
    each = states.groupBy("document_id").agg(F.bool_and(fine).alias("ok"))
    return each.agg(F.count("*").alias("filings"), F.count_if(F.coalesce("ok", F.lit(False)) & F.col("document_id").isNotNull()).alias("processed"))


def with_ingest(summaries: DataFrame, ingested: DataFrame) -> DataFrame:
    """Filing summaries with the ingest result of their document; filings that share an id all get it."""
    return summaries.join(ingested, "document_id", "left")
