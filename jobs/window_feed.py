"""Extraction windows of documents as they arrive.

    python -m jobs.window_feed SOURCE OUT CHECKPOINT [--config jobs/window_feed.json]

SOURCE is a Parquet table documents(doc_id, text, lang, source), a file or a folder that grows. Each run reads the files
that the stream's CHECKPOINT does not know, cuts new documents into pages and overlapping page windows, and writes

    OUT/windows  document_id, window_idx, page_range, page_content, chars; partitioned by batch and lang
    OUT/ledger   document_id, lang, source, windows, status (windowed or empty); partitioned by batch

for the extractor to take window by window. A document is taken once: one whose id an earlier batch has is left out. Of
rows of one batch with equal ids one is taken, by the smallest hash of its text; rows without an id are counted and left out.
A document without a language is in the partition `und`.

A batch overwrites its own partitions alone, windows first, and looks at the ledger of the batches before it alone. So a
batch that failed anywhere is written again with the same result, and a run without new files writes nothing.
"""

from __future__ import annotations

import logging
import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import windows
from loomgraph.operators.iteration import checkpoint
from loomgraph.sources import filings

from .common import command, overwrite, settings, table

log = logging.getLogger(__name__)
DEFAULTS = {"lines_per_page": 3, "window_pages": 3, "window_step": 2, "max_files": 1000}
WINDOWS = "document_id string, window_idx int, page_range string, page_content string, chars int, batch long, lang string"
#: So many ids that were taken earlier or repeat are sent to all tasks at most.
FEW = 10_000
LEDGER = "document_id string, lang string, source string, windows long, status string, batch long"


def incoming(docs: DataFrame, done: DataFrame) -> DataFrame:
    """New documents, one for each id: (document_id, lang, source, text). Ids alone tell which rows were taken earlier and
    which repeat; where these are few, the others' texts are not moved."""
    named = docs.filter("doc_id IS NOT NULL").select(F.concat(F.lit("document_"), "doc_id").alias("document_id"), "text", F.coalesce("lang", F.lit("und")).alias("lang"), "source")
    seen = done.select("document_id", F.lit(True).alias("seen")).distinct()
    each = named.groupBy("document_id").agg(F.count("*").alias("n")).join(seen, "document_id", "left")
    odd = checkpoint(each.select("document_id", F.coalesce("seen", F.lit(False)).alias("seen"), "n").filter("seen OR n > 1"))
    known = odd.agg(F.count("*").alias("all"), F.count_if(~F.col("seen")).alias("repeated")).first()
    if known["all"] > FEW:
        return one_of_each(filings.pending(named, done))
    if not known["all"]:
        return named
    single = filings.pending(named, F.broadcast(odd))
    return single.unionByName(one_of_each(named.join(F.broadcast(odd.filter("NOT seen").select("document_id")), "document_id", "left_semi"))) if known["repeated"] else single


def one_of_each(new: DataFrame) -> DataFrame:
    """Of rows with equal ids the one with the smallest hash of its text."""
    mark = F.struct(F.xxhash64("text").alias("hash"), "lang", "source")
    return new.groupBy("document_id").agg(F.min(mark).alias("m"), F.min_by("text", mark).alias("text")).select("document_id", "m.lang", "m.source", "text")


def feed(docs: DataFrame, batch: int, out: str, config: dict[str, Any]) -> dict[str, int]:
    """Write one batch of documents and return what was read and written."""
    spark = docs.sparkSession
    earlier = table(spark, f"{out}/ledger", LEDGER).filter(F.col("batch") < batch)
    texts = incoming(docs, earlier)
    cut = texts.select("document_id", "lang", F.inline(windows.of_lines(F.col("text"), config["lines_per_page"], config["window_pages"], config["window_step"])))
    made = cut.withColumns({"chars": F.length("page_content"), "batch": F.lit(batch).cast("long")})
    new = texts.select("document_id", "lang", "source")
    overwrite(made, f"{out}/windows", "batch", "lang")
    written = table(spark, f"{out}/windows", WINDOWS).filter(F.col("batch") == batch).groupBy("document_id").agg(F.count("*").alias("windows"))
    entry = new.join(written, "document_id", "left").withColumn("windows", F.coalesce("windows", F.lit(0)).cast("long"))
    entry = entry.withColumns({"status": F.when(F.col("windows") > 0, "windowed").otherwise("empty"), "batch": F.lit(batch).cast("long")})
    overwrite(entry, f"{out}/ledger", "batch")
    read = docs.agg(F.count("*").alias("rows"), F.count_if(F.col("doc_id").isNull()).alias("nameless")).first()
    wrote = table(spark, f"{out}/ledger", LEDGER).filter(F.col("batch") == batch).agg(F.count("*").alias("documents"), F.coalesce(F.sum("windows"), F.lit(0)).alias("windows"), F.count_if(F.col("status") == "empty").alias("empty")).first()
    done = {"rows": read.rows, "without_id": read.nameless, "documents": wrote.documents, "empty": wrote["empty"], "windows": wrote.windows}
    log.info("batch %d: read %d rows (%d without id), wrote %d documents (%d empty) and %d windows", batch, *done.values())
    return done


def run(spark: SparkSession, source: str, out: str, checkpoint: str, config: dict[str, Any] | None = None) -> dict[str, int]:
    """Take all files of source that the checkpoint does not know; returns totals of this run."""
    config = settings(config, DEFAULTS)
    totals = dict.fromkeys(("batches", "rows", "without_id", "documents", "empty", "windows"), 0)
    source = source.rstrip("/")
    schema = spark.read.parquet(source).schema
    # A stream reads a folder or a pattern; the pattern that fits this path alone stands for a single file, too.
    pattern = f"{source[:-1]}[{source[-1]}]"
    log.info("reading %s", source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["max_files"]).parquet(pattern)

    def each(docs: DataFrame, batch: int) -> None:
        done = feed(docs, batch, out, config)
        totals["batches"] += 1
        for k, v in done.items():
            totals[k] += v

    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("%d batches, %d documents, %d windows to %s", totals["batches"], totals["documents"], totals["windows"], out)
    return totals


if __name__ == "__main__":
    raise SystemExit(command(run, __doc__, ("source", "out", "checkpoint"), f"{os.path.dirname(os.path.abspath(__file__))}/window_feed.json"))
