"""The question loop: a planner calls tools until it submits an answer. Evidence is what the tools brought."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from typing import Any, Protocol

from ..operators import retrieval
from ..operators.evidence import Evidence
from .session import GraphSession

ROUNDS = 12
#: Characters of evidence that a submission gives back.
SHOWN = 500
NO_ANSWER = "(no answer)"


@dataclass
class Call:
    tool: str
    args: dict[str, Any] = field(default_factory=dict)


@dataclass
class Reply:
    """A planner's turn: calls of tools, or a text that is the answer."""

    calls: list[Call] = field(default_factory=list)
    text: str | None = None


class Planner(Protocol):
    def __call__(self, messages: list[dict[str, Any]]) -> Reply: ...


class Answerer(Protocol):
    def __call__(self, question: str, evidence: str) -> str: ...


@dataclass
class Result:
    question: str
    answer: str = NO_ANSWER
    confidence: str = "UNKNOWN"
    has_sufficient_data: bool = False
    missing_data: str | None = None
    assessment: dict[str, Any] | None = None
    plan: list[Any] | None = None
    tool_calls: list[dict[str, Any]] = field(default_factory=list)
    graph_context: str = ""


#: Tools and their parameters: name -> (parameter -> required).
TOOLS: dict[str, dict[str, bool]] = {
    "assess_query": {"intent": True, "entities_mentioned": False, "time_periods": False, "metrics_or_facts": False},
    "plan_retrieval": {"data_items": True},
    "search_nodes": {"query": True, "entity_type": False},
    "get_neighbors": {"entity_id": True, "depth": False, "rel_type": False},
    "run_query": {"query": True, "params": False},
    "submit_answer": {"has_sufficient_data": True, "answer": True, "confidence": True, "missing_data": False},
}


class ScriptedPlanner:
    """Gives prepared turns one after another; for tests and offline use."""

    def __init__(self, *turns: Reply):
        self.turns = list(turns)

    def __call__(self, messages: list[dict[str, Any]]) -> Reply:
        return self.turns.pop(0) if self.turns else Reply(text=None, calls=[Call("plan_retrieval", {"data_items": []})])


class Tools:
    """The tools of one question. A failure becomes the tool's result, and the loop goes on."""

    def __init__(self, graph: GraphSession, evidence: Evidence):
        self.graph, self.evidence = graph, evidence
        self.table: dict[str, Callable[..., dict[str, Any]]] = {name: getattr(self, name) for name in TOOLS}

    def call(self, call: Call) -> dict[str, Any]:
        if call.tool not in self.table:
            return {"error": f"Unknown tool: {call.tool}"}
        known = {k: v for k, v in call.args.items() if k in TOOLS[call.tool]}
        if missing := [k for k, required in TOOLS[call.tool].items() if required and k not in known and call.tool not in ("assess_query", "submit_answer", "plan_retrieval")]:
            return {"error": f"Missing: {', '.join(missing)}"}
        try:
            return self.table[call.tool](**known)
        except Exception as e:  # noqa: BLE001
            return {"error": str(e).splitlines()[0][:SHOWN]}

    def assess_query(self, **_: Any) -> dict[str, Any]:
        return {"status": "ok"}

    def plan_retrieval(self, data_items: list[Any] | None = None) -> dict[str, Any]:
        return {"status": "ok", "items_planned": len(data_items or [])}

    def search_nodes(self, query: str, entity_type: str | None = None) -> dict[str, Any]:
        found = [r.asDict(recursive=True) for r in self.graph.search(query, entity_type).collect()]
        self.evidence.add_nodes(found)
        return {"nodes_found": len(found), "nodes": found}

    def get_neighbors(self, entity_id: str, depth: int = 1, rel_type: str | None = None) -> dict[str, Any]:
        paths = self.graph.neighbors(entity_id, depth, rel_type)
        found = [r.asDict(recursive=True) for r in retrieval.full(retrieval.nodes_on(paths, self.graph.nodes)).collect()]
        edges = [r.asDict(recursive=True) for r in retrieval.edges_on(paths).collect()]
        # Evidence keeps the sources that an answer cites; the reply goes without them.
        self.evidence.add_nodes(found)
        self.evidence.add_relationships(edges)
        nodes = [{k: v for k, v in n.items() if k not in retrieval.LONG} for n in found]
        return {"nodes_found": len(nodes), "relationships_found": len(edges), "nodes": nodes, "relationships": edges}

    def run_query(self, query: str, params: dict[str, Any] | None = None) -> dict[str, Any]:
        from .guard import NotReadOnly

        try:
            rows = [r.asDict(recursive=True) for r in self.graph.sql(query, params).collect()]
        except NotReadOnly as e:  # a refused query leaves no evidence
            return {"error": str(e)}
        except Exception as e:  # noqa: BLE001  a failed one does
            rows = [{"error": str(e).splitlines()[0][:SHOWN]}]
        self.evidence.rows += rows
        return {"rows_returned": len(rows), "rows": rows}

    def submit_answer(self, **_: Any) -> dict[str, Any]:
        return {"status": "ok", "graph_evidence_summary": self.evidence.text()[:SHOWN]}


def ask(graph: GraphSession, question: str, planner: Planner, answerer: Answerer, rounds: int = ROUNDS) -> Result:
    """Answer a question. The loop ends with a submitted answer that is not empty, or a text without calls; after the
    last round the answerer answers from the evidence."""
    evidence = Evidence()
    tools, result, submitted = Tools(graph, evidence), Result(question), False
    messages: list[dict[str, Any]] = [{"role": "user", "content": f"{question}\n\nGraph contents:\n{graph.schema_summary()}"}]
    for _ in range(rounds):
        reply = planner(messages)
        messages.append({"role": "assistant", "content": reply.text, "calls": [asdict(c) for c in reply.calls]})
        if not reply.calls:
            if not submitted:
                submitted = True
                result.answer, result.confidence, result.has_sufficient_data = reply.text or NO_ANSWER, "MEDIUM", True
            break
        for call in reply.calls:
            result.tool_calls.append({"tool": call.tool, "args": call.args})
            out = tools.call(call)
            messages.append({"role": "tool", "tool": call.tool, "content": json.dumps(out, default=str)})
            if call.tool == "assess_query":
                result.assessment = call.args
            elif call.tool == "plan_retrieval":
                result.plan = call.args.get("data_items", [])
            elif call.tool == "submit_answer":
                submitted = True
                result.answer = call.args.get("answer", "")
                result.confidence = call.args.get("confidence", "LOW")
                result.has_sufficient_data = bool(call.args.get("has_sufficient_data", False))
                result.missing_data = call.args.get("missing_data")
                break
        if submitted and result.answer:
            break
    if not submitted:
        result.answer, result.confidence = answerer(question, evidence.text()), "LOW"
        result.has_sufficient_data = not evidence.empty()
        result.missing_data = "The rounds ended before an answer was submitted."
    elif not result.answer and result.has_sufficient_data:
        result.answer = answerer(question, evidence.text())
    result.graph_context = evidence.text()
    return result
