"""A graph that can be asked: tables, views and the tools over them."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..operators import retrieval
from .guard import read_only
from .patterns import Match


@dataclass(frozen=True)
class Settings:
    """Where things are. Defaults are relative folders; nothing is read from the environment."""

    raw: str = "data/raw"
    parsed: str = "data/parsed"
    extracted: str = "data/extracted"
    graph: str = "data/graph"

    @classmethod
    def read(cls, path: str) -> Settings:
        """Settings from a JSON file; what it does not name keeps its default, and an unknown name is an error."""
        with open(path) as f:
            return cls(**json.load(f))


class GraphSession:
    """Lazy frames over nodes and edges; the caller owns the SparkSession."""

    def __init__(self, spark: SparkSession, nodes: DataFrame, edges: DataFrame, prefix: str = ""):
        self.spark, self.nodes, self.edges, self.views = spark, nodes, edges, (f"{prefix}nodes", f"{prefix}edges")
        nodes.createOrReplaceTempView(f"{prefix}nodes")
        edges.createOrReplaceTempView(f"{prefix}edges")

    def search(self, query: str, entity_type: str | None = None, limit: int | None = retrieval.SEARCH_LIMIT) -> DataFrame:
        return retrieval.search(self.nodes, query, entity_type, limit)

    def neighbors(self, entity_id: str, depth: int = 1, rel_type: str | None = None, limit: int | None = retrieval.PATH_LIMIT) -> DataFrame:
        return retrieval.neighbors(self.edges, entity_id, depth, rel_type, limit)

    def match(self) -> Match:
        return Match(self.nodes, self.edges)

    def sql(self, text: str, args: dict[str, Any] | None = None, limit: int | None = retrieval.ROW_LIMIT) -> DataFrame:
        found = read_only(self.spark, text, args, self.views)
        return found if limit is None else found.limit(limit)

    def schema_summary(self) -> str:
        return retrieval.schema_summary(self.nodes, self.edges)
