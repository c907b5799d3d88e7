"""A chat model behind the extractor, planner and answerer boundaries.

`complete(messages, tools)` is any function that sends messages to a model and returns a dict with `content` and
`tool_calls` (a list of name and arguments as JSON text or dict). It must be serializable where it is used on executors.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from ..ontology import ENTITY_TYPES, RELATIONSHIP_TYPES
from .agent import TOOLS, Call, Reply

Complete = Callable[[list[dict[str, Any]], list[dict[str, Any]] | None], dict[str, Any]]

#: What each tool does, for the model.
_ABOUT = {
    "assess_query": "Record what the question asks for: intent, entities, periods, facts.",
    "plan_retrieval": "Record the data items to look for.",
    "search_nodes": "Find nodes whose name holds a text, of one type if given.",
    "get_neighbors": "Expand a node by one or two hops, over one relationship type if given.",
    "run_query": "Run a read-only SQL query over the views nodes and edges.",
    "submit_answer": "Submit the answer and end.",
}
_KINDS = {"depth": "integer", "has_sufficient_data": "boolean", "params": "object", "data_items": "array", "entities_mentioned": "array", "time_periods": "array", "metrics_or_facts": "array"}


def tool_definitions() -> list[dict[str, Any]]:
    """JSON schemas of the tools."""
    return [
        {
            "type": "function",
            "function": {
                "name": name,
                "description": _ABOUT[name],
                "parameters": {
                    "type": "object",
                    "properties": {p: {"type": _KINDS.get(p, "string")} for p in parameters},
                    "required": [p for p, needed in parameters.items() if needed],
                },
            },
        }
        for name, parameters in TOOLS.items()
    ]


def extraction_prompt(document_id: str, page_range: str, content: str, known_ids: list[str], filing_year: int | None = None) -> list[dict[str, Any]]:
    """Messages that ask for the entities and relationships of one window."""
    rules = [
        "Answer with one JSON object and nothing else: entities (id, type, properties, source) and relationships (source_id, target_id, type, properties, source); a source has page_num and section.",
        f"Entity types and their properties: {json.dumps(ENTITY_TYPES)}",
        f"Relationship types: {json.dumps(RELATIONSHIP_TYPES)}",
        "Take only what the text states. When in doubt, leave it out.",
        "An id is the lower-case type, an underscore and the name as a slug; reuse known ids instead of making new ones.",
        "Write sums of money as a number in millions with currency and unit apart.",
        "Every relationship has filing_year among its properties; structural changes have effective_date where it is known; segments are active unless the text says otherwise.",
    ]
    window = [f"Document: {document_id}", *([f"Filing year: {filing_year}"] if filing_year else []), f"Known ids: {json.dumps(known_ids)}", f"Pages {page_range}:", content]
    return [{"role": "system", "content": "\n".join(rules)}, {"role": "user", "content": "\n".join(window)}]


class ChatExtractor:
    """An extractor that asks a model."""

    def __init__(self, complete: Complete, filing_year: int | None = None):
        self.complete, self.filing_year = complete, filing_year

    def __call__(self, document_id: str, page_range: str, content: str, known_ids: list[str]) -> str | None:
        return self.complete(extraction_prompt(document_id, page_range, content, known_ids, self.filing_year), None).get("content")


class ChatPlanner:
    """A planner that asks a model with the tools."""

    def __init__(self, complete: Complete):
        self.complete = complete

    def __call__(self, messages: list[dict[str, Any]]) -> Reply:
        system = "Answer from the graph alone: assess the question, plan, fetch with the tools, then submit an answer with its sources, or say what is missing."
        out = self.complete([{"role": "system", "content": system}, *messages], tool_definitions())
        calls = []
        for c in out.get("tool_calls") or []:
            args = c["arguments"]
            try:
                calls.append(Call(c["name"], json.loads(args) if isinstance(args, str) else args))
            except ValueError:
                calls.append(Call(c["name"], {}))
        return Reply(calls, out.get("content"))


class ChatAnswerer:
    """An answerer that asks a model to answer from the evidence."""

    def __init__(self, complete: Complete):
        self.complete = complete

    def __call__(self, question: str, evidence: str) -> str:
        text = f"Answer the question from this evidence alone, with sources; say so if it is not enough.\n\n{evidence}\n\nQuestion: {question}"
        return self.complete([{"role": "user", "content": text}], None).get("content") or "(no answer)"
