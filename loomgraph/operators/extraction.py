"""From windows to entities and relationships: the extractor's boundary, validation, merge and dedup."""

from __future__ import annotations

import json
import time
from collections import deque
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import ontology
from ..functions.properties import is_object, merged
from ..schemas import RESPONSE

#: Characters of a response that an error record keeps.
KEPT = 200


class Extractor(Protocol):
    """Reads one window. It gets the ids found in earlier windows of the document and returns JSON text, or None."""

    def __call__(self, document_id: str, page_range: str, content: str, known_ids: list[str]) -> str | None: ...


class Throttle:
    """At most `calls` calls in any `seconds` seconds, in one worker."""

    def __init__(self, calls: int = 20, seconds: float = 60.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.calls, self.seconds, self.clock, self.sleep = calls, seconds, clock, sleep
        self.began: deque[float] = deque()

    def wait(self) -> None:
        now = self.clock()
        while self.began and now - self.began[0] >= self.seconds:
            self.began.popleft()
        if len(self.began) >= self.calls:
            self.sleep(self.seconds - (now - self.began[0]))
            return self.wait()
        self.began.append(now)


class NameExtractor:
    """An offline extractor: sentences `<name> operates in <place>` and sums of money. For tests and examples."""

    def __call__(self, document_id: str, page_range: str, content: str, known_ids: list[str]) -> str | None:
        import re

        entities, relations = {}, []
        slug = lambda kind, name: f"{kind}_" + re.sub("[^a-z0-9]+", "_", name.lower()).strip("_")
        for who, where in re.findall(r"([A-Z]\w+(?: [A-Z]\w+)*) operates in ([A-Z]\w+)", content):
            a, b = slug("company", who), slug("geography", where)
            source = {"page_num": int(page_range.split("-")[0]), "section": "text"}
            for key, kind, name in ((a, "Company", who), (b, "Geography", where)):
                if key not in known_ids:
                    entities[key] = {"id": key, "type": kind, "properties": {"name": name}, "source": source}
            relations.append({"source_id": a, "target_id": b, "type": "OPERATES_IN", "properties": {}, "source": source})
        return json.dumps({"entities": list(entities.values()), "relationships": relations})


def responses(windows: DataFrame, extractor: Extractor, throttle: tuple[int, float] | None = None) -> DataFrame:
    """(document_id, window_idx, page_range, response) of windows(document_id, window_idx, page_range, page_content).

    A document's windows are read in order in one task, as each needs the ids of those before it; documents are
    independent. throttle: calls and seconds, for each worker. A call that fails gives a null response.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slow = Throttle(*throttle) if throttle else None
        document, known = None, []
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.document_id != document:
                    document, known = row.document_id, []
                if slow:
                    slow.wait()
                try:
                    text = extractor(row.document_id, row.page_range, row.page_content, list(known))
                except Exception:  # noqa: BLE001  one window's failure is a row, not the job's end
                    text = None
                try:
                    known += [e["id"] for e in json.loads(text or "{}").get("entities", []) if e["id"] not in known]
                except (ValueError, TypeError, KeyError, AttributeError):
                    pass
                out.append((row.document_id, row.window_idx, row.page_range, text))
            yield pd.DataFrame(out, columns=["document_id", "window_idx", "page_range", "response"])

    dealt = windows.select("document_id", "window_idx", "page_range", "page_content").repartition("document_id").sortWithinPartitions("document_id", "window_idx")
    return dealt.mapInPandas(read, "document_id string, window_idx int, page_range string, response string")


def parsed(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, relationships and errors of responses (adds doc_ord if it is there; else 0).

    A response that is not one JSON object, and a null one, are an error of the window alone; so is a record without an id.
    The document's own id is stamped on each source. seq orders all records: by document, window and place.
    """
    if "doc_ord" not in found.columns:
        found = found.withColumn("doc_ord", F.lit(0).cast("long"))
    good = is_object(F.col("response"))
    read = found.withColumn("r", F.from_json(F.when(good, F.col("response")), RESPONSE))
    key = ["document_id", "doc_ord", "window_idx"]
    seq = (F.col("doc_ord").cast("long") * (1 << 40) + F.col("window_idx").cast("long") * (1 << 20) + F.col("pos")).cast("long").alias("seq")
    source = lambda c: F.struct(F.col("document_id"), F.col(f"{c}.source.page_num").alias("page_num"), F.col(f"{c}.source.section").alias("section"))
    e = read.select(*key, F.posexplode("r.entities").alias("pos", "e"))
    entities = e.select(*key, "pos", seq, "e.id", F.coalesce("e.type", F.lit("")).alias("type"), "e.properties", source("e").alias("source"))
    r = read.select(*key, F.posexplode("r.relationships").alias("pos", "r"))
    relationships = r.select(*key, "pos", seq, "r.source_id", "r.target_id", F.coalesce("r.type", F.lit("")).alias("type"), "r.properties", source("r").alias("source"))
    bad = read.filter(~good | F.col("response").isNull()).select("document_id", F.col("page_range").alias("pages"), F.coalesce(F.concat(F.lit("unreadable JSON: "), F.substring("response", 1, KEPT)), F.lit("the extractor failed")).alias("message"))
    nameless = entities.filter("id IS NULL").select("document_id", F.col("window_idx").cast("string").alias("pages"), F.lit("an entity has no id").alias("message"))
    loose = relationships.filter("source_id IS NULL OR target_id IS NULL").select("document_id", F.col("window_idx").cast("string").alias("pages"), F.lit("a relationship has no endpoint").alias("message"))
    kept = ontology.valid(entities.filter("id IS NOT NULL"))
    linked = ontology.valid(relationships.filter("source_id IS NOT NULL AND target_id IS NOT NULL"), "relationship")
    return kept, linked, bad.unionByName(nameless).unionByName(loose)


def merge_entities(entities: DataFrame) -> DataFrame:
    """One row for each id of a document: the first type and source, properties last-wins, at its first place. Files that
    share a document_id, or have none, are documents of their own by doc_ord."""
    own = ["document_id", "doc_ord", "id"]
    first = entities.groupBy(*own).agg(F.min("seq").alias("seq"), F.min_by("type", "seq").alias("type"), F.min_by("source", "seq").alias("source"))
    return first.join(merged(entities, own), own, "left").select("document_id", "id", "doc_ord", "seq", "type", "source", "properties")


def year_key(properties: str = "properties"):
    """The filing year as JSON text: 2024 and "2024" are two years, and no year is one of its own."""
    return F.to_json(F.try_element_at(properties, F.lit("filing_year")))


def dedup_relationships(relationships: DataFrame) -> DataFrame:
    """The first of a document's relationships with the same ends, type and filing year; documents as in merge_entities()."""
    own = ["document_id", *(c for c in ("doc_ord",) if c in relationships.columns)]
    same = Window.partitionBy(*own, "source_id", "type", "target_id", "year_key").orderBy("seq")
    keyed = relationships.withColumn("year_key", year_key()).withColumn("nth", F.row_number().over(same))
    return keyed.filter("nth = 1").drop("nth", "year_key")
