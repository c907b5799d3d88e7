"""Evidence of a question: nodes, edges and rows as they were found, each once."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NOTHING = "(no graph evidence collected)"
# The headings of the text form.
HEADINGS = {"nodes": "=== NODES ===", "relationships": "=== RELATIONSHIPS ===", "rows": "=== QUERY RESULTS ==="}


def first_of(rows: DataFrame, *key: str, seq: str = "seq") -> DataFrame:
    """The first row of each key in the order of `seq`."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(seq))
    return rows.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


def union(*found: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Rows of several retrievals, the earliest of each key; columns that one lacks are null."""
    every = found[0].withColumn("seq", F.lit(0))
    for i, more in enumerate(found[1:], 1):
        every = every.unionByName(more.withColumn("seq", F.lit(i)), allowMissingColumns=True)
    return first_of(every, *key)


def node_lines(nodes: DataFrame) -> DataFrame:
    """(entity_id, line) of nodes(entity_id, entity_type, name)."""
    return nodes.select("entity_id", F.format_string("- [%s] %s (id=%s)", F.coalesce("entity_type", F.lit("")), F.coalesce("name", "entity_id"), "entity_id").alias("line"))


def edge_lines(edges: DataFrame) -> DataFrame:
    return edges.select("src", "type", "tgt", F.format_string("- (%s) -[%s]-> (%s)", "src", "type", "tgt").alias("line"))


@dataclass
class Evidence:
    """What the tools of one question brought to the driver: limited rows."""

    nodes: dict[str, dict[str, Any]] = field(default_factory=dict)
    relationships: dict[tuple, dict[str, Any]] = field(default_factory=dict)
    rows: list[dict[str, Any]] = field(default_factory=list)

    def add_nodes(self, found: list[dict[str, Any]]) -> None:
        for n in found:
            self.nodes.setdefault(n["entity_id"], n)

    def add_relationships(self, found: list[dict[str, Any]]) -> None:
        for r in found:
            self.relationships.setdefault((r["src"], r["type"], r["tgt"]), r)

    def empty(self) -> bool:
        return not (self.nodes or self.relationships or self.rows)

    def text(self) -> str:
        parts = []
        if self.nodes:
            lines = []
            for key, n in self.nodes.items():
                rest = {k: v for k, v in n.items() if k not in ("entity_id", "entity_type", "name", "sources", "labels") and v is not None}
                line = f"- [{n.get('entity_type', '')}] {n.get('name') or key} (id={key})"
                line += f"  {json.dumps(rest, ensure_ascii=False, default=str)}" if rest else ""
                line += f"  [sources: {', '.join(map(str, n['sources']))}]" if n.get("sources") else ""
                lines.append(line)
            parts.append("\n".join([HEADINGS["nodes"], *lines]))
        if self.relationships:
            lines = []
            for (src, kind, tgt), r in self.relationships.items():
                rest = {k: v for k, v in r.items() if k not in ("src", "type", "tgt", "sources") and v is not None}
                lines.append(f"- ({src}) -[{kind}]-> ({tgt})" + (f"  {json.dumps(rest, ensure_ascii=False, default=str)}" if rest else ""))
            parts.append("\n".join([HEADINGS["relationships"], *lines]))
        if self.rows:
            parts.append("\n".join([HEADINGS["rows"], *[f"  {json.dumps(r, ensure_ascii=False, default=str)}" for r in self.rows]]))
        return "\n\n".join(parts) if parts else NOTHING
