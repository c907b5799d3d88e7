"""Sliding page windows over a document, and their text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

SIZE, STEP = 3, 2
EMPTY = "(no extractable text)"


def _last(n_pages: Column, size: int, step: int) -> Column:
    """The last window's index."""
    if not 0 < step <= size:
        raise ValueError("step must be from 1 to size")
    return F.greatest(F.lit(0), F.ceil((n_pages - size) / step)).cast("int")


def build(counts: DataFrame, size: int = SIZE, step: int = STEP) -> DataFrame:
    """(document_id, window_idx, start_idx, end_idx) of counts(document_id, n_pages); the end is exclusive.

    Windows begin every `step` pages until one reaches the last page, which may be shorter. No pages, no windows.
    """
    last = _last(F.col("n_pages"), size, step)
    some = counts.filter("n_pages > 0").select("document_id", "n_pages", F.explode(F.sequence(F.lit(0), last)).alias("window_idx"))
    start = F.col("window_idx") * step
    return some.select("document_id", "window_idx", start.alias("start_idx"), F.least(start + size, F.col("n_pages")).cast("int").alias("end_idx"))


def page_counts(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("document_id").agg((F.max("page_idx") + 1).cast("int").alias("n_pages"))


def pages_of(windows: DataFrame, pages: DataFrame, size: int = SIZE, step: int = STEP) -> DataFrame:
    """windows joined with their pages(document_id, page_idx, ...).

    A page lies in the windows that begin in the `size` pages up to it, so it names them itself and the join is one of
    equal keys, not of ranges.
    """
    first = F.greatest(F.lit(0), F.ceil((F.col("page_idx") - size + 1) / step)).cast("int")
    named = pages.withColumn("window_idx", F.explode(F.sequence(first, F.floor(F.col("page_idx") / step).cast("int"))))
    return windows.join(named, ["document_id", "window_idx"]).filter("page_idx >= start_idx AND page_idx < end_idx")


def of_lines(text: Column, lines: int, size: int = SIZE, step: int = STEP) -> Column:
    """The windows of a plain text with so many lines a page, as texts() has them of its blocks: an array of (window_idx,
    page_range, page_content), null for null. A text is in one row already, so its windows are cut there and not moved."""

    def once(value: Column, then: Callable[[Column], Column]) -> Column:
        """A value that a lambda binds, so that it is made once however often it is used."""
        return F.get(F.transform(F.array(value), then), F.lit(0))

    def page(found: Column, p: Column) -> Column:
        body = F.array_join(F.filter(F.slice(found, p * lines + 1, F.lit(lines)), lambda x: x != ""), "\n")
        return once(body, lambda b: F.when(b != "", F.concat(F.lit("[Page "), (p + 1).cast("string"), F.lit("]\n"), b)))

    def window(pages: Column, w: Column) -> Column:
        start, body = w * step, F.array_join(F.slice(pages, w * step + 1, F.lit(size)), "\n\n")  # pages without text are null
        spans = F.concat_ws("-", (start + 1).cast("string"), F.least(start + size, F.size(pages)).cast("string"))
        return F.struct(w.alias("window_idx"), spans.alias("page_range"), once(body, lambda b: F.when(b != "", b).otherwise(EMPTY)).alias("page_content"))

    def cut(pages: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), _last(F.size(pages), size, step)), lambda w: window(pages, w))

    def pages(found: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / lines).cast("int")), lambda p: page(found, p))

    stripped = F.transform(F.split(text, "\n"), strip)
    return F.when(text.isNotNull(), once(stripped, lambda found: once(pages(found), cut)))


def texts(blocks: DataFrame, size: int = SIZE, step: int = STEP) -> DataFrame:
    """(document_id, window_idx, page_range, page_content) of all windows.

    Blocks are stripped; empty ones, and pages without others, vanish; pages stand under a header with their number.
    """
    windows = build(page_counts(blocks), size, step)
    content = strip(F.col("content"))
    # collect_list leaves out what is null: empty blocks here, pages without text below.
    full = F.collect_list(F.when(content != "", F.struct("block_pos", content.alias("content"))))
    page = blocks.groupBy("document_id", "page_idx").agg(F.min("page_number").alias("page_number"), F.array_sort(full).alias("full"))
    body = F.when(F.size("full") > 0, F.array_join(F.transform("full", lambda x: x["content"]), "\n"))
    page = page.select("document_id", "page_idx", "page_number", body.alias("body"))
    page = page.withColumn("body", F.when(F.col("body").isNotNull(), F.concat(F.lit("[Page "), "page_number", F.lit("]\n"), "body")))
    each = pages_of(windows, page, size, step)
    order = F.when(F.col("body").isNotNull(), F.struct("page_idx", "body"))
    bodies_in_order = F.transform(F.array_sort(F.collect_list(order)), lambda x: x["body"])
    return each.groupBy("document_id", "window_idx").agg(
        F.concat_ws("-", F.min_by("page_number", "page_idx"), F.max_by("page_number", "page_idx")).alias("page_range"),
        F.when(F.size(bodies_in_order) > 0, F.array_join(bodies_in_order, "\n\n")).otherwise(EMPTY).alias("page_content"),
    )


def known_before(entities: DataFrame) -> DataFrame:
    """(document_id, window_idx, known_ids): ids of entities(document_id, window_idx, id) of earlier windows of the
    document, in order. Each id counts from its first window on, so a document's rows are its distinct ids."""
    first = entities.groupBy("document_id", "id").agg(F.min("window_idx").alias("since"))
    new = first.groupBy("document_id", F.col("since").alias("window_idx")).agg(F.collect_list("id").alias("new"))
    every = entities.select("document_id", "window_idx").distinct().join(new, ["document_id", "window_idx"], "left")
    before = Window.partitionBy("document_id").orderBy("window_idx").rowsBetween(Window.unboundedPreceding, -1)
    return every.select("document_id", "window_idx", F.array_sort(F.flatten(F.collect_list("new").over(before))).alias("known_ids"))
