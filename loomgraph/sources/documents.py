"""Parsers and files: what becomes blocks, and what extraction left."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import strip

BLOCKS = "document_id string, page_idx int, page_number int, block_pos int, block_type string, block_order int, content string"
LINES_PER_PAGE = 3


def blocks_of_lines(docs: DataFrame, lines_per_page: int = LINES_PER_PAGE) -> DataFrame:
    """Plain text: each line of documents(doc_id, text) is a block, and so many lines are a page."""
    lines = docs.select(F.concat(F.lit("document_"), "doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("line", "content"))
    page = F.floor(F.col("line") / lines_per_page).cast("int")
    at = (F.col("line") % lines_per_page).cast("int")
    return lines.select("document_id", page.alias("page_idx"), (page + 1).alias("page_number"), at.alias("block_pos"), F.lit("text").alias("block_type"), at.alias("block_order"), "content")


def blocks_of_html(pages: DataFrame) -> DataFrame:
    """Web pages: headings and paragraphs of pages(page_id, html) are the blocks of one page."""
    parts = F.regexp_extract_all("html", F.lit(r"(?is)<(?:h[1-6]|p)\b[^>]*>.*?(?=<(?:h[1-6]|p|footer|/article|/body)\b|$)"), F.lit(0))
    cut = pages.select(F.concat(F.lit("page_"), "page_id").alias("document_id"), F.posexplode(parts).alias("block_pos", "raw"))
    text = strip(F.regexp_replace(F.regexp_replace("raw", r"(?s)<[^>]*>", " "), r"\s+", " "))
    kind = F.when(F.lower("raw").startswith("<h"), "heading").otherwise("text")
    zero = F.lit(0)
    return cut.select("document_id", zero.alias("page_idx"), (zero + 1).alias("page_number"), "block_pos", kind.alias("block_type"), F.col("block_pos").alias("block_order"), text.alias("content"))


def blocks_of_turns(conversations: DataFrame) -> DataFrame:
    """Conversations: each turn is a page of one block, typed by its role."""
    turn = F.col("turn").cast("int")
    return conversations.select(F.concat(F.lit("conversation_"), "conv_id").alias("document_id"), turn.alias("page_idx"), (turn + 1).alias("page_number"), F.lit(0).alias("block_pos"), F.col("role").alias("block_type"), F.lit(0).alias("block_order"), F.col("text").alias("content"))


def blocks_of_chunks(chunks: DataFrame) -> DataFrame:
    """A layout parser's pages: chunks(document_id, page_idx, text, metadata, page_boxes) are sliced at [start, end)."""
    box = F.col("box")
    cut = chunks.select("document_id", "page_idx", F.col("metadata.page_number").alias("page_number"), "text", F.posexplode("page_boxes").alias("block_pos", "box"))
    return cut.select("document_id", "page_idx", "page_number", "block_pos", box["class"].alias("block_type"), box["index"].alias("block_order"), F.substring(F.col("text"), box["pos"][0] + 1, box["pos"][1] - box["pos"][0]).alias("content"))


def parsed_with(files: DataFrame, parser: Callable[[str, bytes], list[tuple]]) -> DataFrame:
    """Blocks that a parser of binary files gives: parser(path, content) lists (page_idx, page_number, block_pos,
    block_type, block_order, content). files(document_id, path, content) is what the binaryFile source reads."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in BLOCKS.split(", ")]
        for batch in batches:
            rows = [(d, *r) for d, p, c in zip(batch["document_id"], batch["path"], batch["content"]) for r in parser(p, bytes(c))]
            yield pd.DataFrame(rows, columns=names)

    return files.select("document_id", "path", "content").mapInPandas(parse, BLOCKS)


def tree(blocks: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """Blocks as one row for each document, with nested pages. headers: (document_id, name, format, file_path)."""
    block = F.struct("block_pos", F.struct("block_type", "block_order", "content").alias("block"))
    pages = blocks.groupBy("document_id", "page_idx").agg(F.min("page_number").alias("page_number"), F.array_sort(F.collect_list(block)).alias("b"))
    page = F.struct("page_idx", F.struct("page_number", F.transform("b", lambda x: x["block"]).alias("blocks")).alias("page"))
    docs = pages.groupBy("document_id").agg(F.array_sort(F.collect_list(page)).alias("p"))
    docs = docs.select(F.col("document_id").alias("id"), F.transform("p", lambda x: x["page"]).alias("pages"))
    if headers is None:
        headers = docs.select(F.col("id").alias("document_id"), F.col("id").alias("name"), F.lit(None).cast("string").alias("format"), F.lit(None).cast("string").alias("file_path"))
    known = headers.select(F.col("document_id").alias("id"), "name", "format", "file_path")
    return docs.join(known, "id", "left").select("id", "name", F.struct(F.size("pages").alias("page_count"), "format", "file_path").alias("metadata"), "pages")


def blocks_of_tree(docs: DataFrame) -> DataFrame:
    """The blocks of parsed documents; a document without pages has none."""
    pages = docs.select(F.col("id").alias("document_id"), F.posexplode("pages").alias("page_idx", "page"))
    cut = pages.select("document_id", "page_idx", F.col("page.page_number"), F.posexplode("page.blocks").alias("block_pos", "block"))
    return cut.select("document_id", "page_idx", "page_number", "block_pos", "block.block_type", "block.block_order", "block.content")


def read_parsed(spark: SparkSession, path: str) -> DataFrame:
    """Parsed documents from JSON files; missing pages are none. A file without an id is an error of its stage."""
    found = spark.read.schema(schemas.PARSED).option("multiLine", "true").option("pathGlobFilter", "*.json").json(path)
    return found.withColumn("pages", F.coalesce("pages", F.array().cast(found.schema["pages"].dataType)))


def read_extractions(spark: SparkSession, path: str) -> DataFrame:
    """Extraction results from one JSON file or a folder of them, in the order of their names (doc_ord)."""
    found = spark.read.schema(schemas.EXTRACTION).option("multiLine", "true").option("pathGlobFilter", "*.json").json(path)
    types = {f.name: f.dataType for f in found.schema.fields}
    return found.select(
        F.coalesce("document_id", F.lit("unknown")).alias("document_id"),
        *[F.coalesce(c, F.array().cast(types[c])).alias(c) for c in ("entities", "relationships", "errors")],
        F.col("_metadata.file_path").alias("file_path"),
    )


def records(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entity and relationship records of extraction results with doc_ord, in the order of their lists. Where a file's lists
    are dealt over several rows, `place` says where those of a row begin; places between rows may be left out."""
    place = F.col("place") if "place" in found.columns else F.lit(0)
    found = found.withColumn("place", place.cast("long"))
    seq = (F.col("doc_ord") * (1 << 40) + F.col("place") + F.col("pos")).cast("long").alias("seq")
    stamped = lambda c: F.struct("document_id", F.col(f"{c}.source.page_num").alias("page_num"), F.col(f"{c}.source.section").alias("section")).alias("source")
    e = found.select("document_id", "doc_ord", "place", F.posexplode("entities").alias("pos", "e"))
    r = found.select("document_id", "doc_ord", "place", F.posexplode("relationships").alias("pos", "r"))
    entities = e.select("document_id", "doc_ord", seq, "e.id", "e.type", "e.properties", stamped("e")).filter("id IS NOT NULL")
    relationships = r.select("document_id", "doc_ord", seq, "r.source_id", "r.target_id", "r.type", "r.properties", stamped("r")).filter("source_id IS NOT NULL AND target_id IS NOT NULL")
    return entities, relationships


def page_sizes(blocks: DataFrame) -> DataFrame:
    """(document_id, page_idx, blocks) of all pages."""
    return blocks.groupBy("document_id", "page_idx").agg(F.count("*").alias("blocks"))


def write_json(df: DataFrame, path: str, key: str) -> None:
    """One folder of JSON lines for each key, non-ASCII kept; a later run replaces the keys that it brings."""
    df.withColumn("_key", F.col(key)).write.partitionBy("_key").mode("overwrite").option("partitionOverwriteMode", "dynamic").json(path)
