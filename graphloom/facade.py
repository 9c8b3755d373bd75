"""One object for all questions to a graph, with results as DataFrames or as JSON text of tool calls."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from graphloom.operators import context, docs, graph, ledger, search
from graphloom.plans import ekl

#: How many rows a tool's answer lists; the DataFrame methods have no such limit.
MOST_LISTED = 200


@dataclass
class Engine:
    """The versions of objects (id, name, kind, evidence, created_at, status, sig) and relationships (id, kind, from, to, evidence, created_at, status), events and evidence."""

    objects: DataFrame
    relationships: DataFrame
    events: DataFrame
    evidence: DataFrame

    def current(self, at: str | None = None) -> tuple[DataFrame, DataFrame]:
        """Objects and relationships now or as of a time."""
        pick = (lambda log, order: ledger.latest(log, "id", order)) if at is None else lambda log, order: ledger.as_of(log, "id", order, "created_at", at)
        return pick(self.objects, ["created_at", "sig"]), pick(self.relationships, ["created_at", "from", "to"])

    def search(self, query: str, limit: int = search.LIMIT) -> DataFrame:
        o, _ = self.current()
        return search.search(o if "content" in o.columns else o.withColumn("content", F.lit("")), query, limit)

    def query(self, text: str) -> DataFrame:
        return ekl.run(text, *self.current())

    def neighbourhood(self, root: str, depth: int = 1) -> tuple[DataFrame, DataFrame]:
        return graph.neighbourhood(*self.current(), root, depth)

    def state(self, nodes: DataFrame, at: str | None = None) -> dict[str, DataFrame]:
        """Objects of nodes (id), what touches them, and their evidence, now or at a time."""
        o, r = self.current(at)
        return graph.state(o, r, self.evidence, nodes)

    def impact(self, root: str | DataFrame, direction: str = "dependents", kinds: list[str] | None = None, most_hops: int = 5) -> DataFrame:
        return graph.trace(*self.current(), root, direction, kinds, most_hops)

    def dependents(self, nodes: DataFrame) -> DataFrame:
        return graph.dependents_named(*self.current(), nodes)

    def world(self, scope: DataFrame, at: str | None = None) -> dict[str, DataFrame]:
        o, r = self.current(at)
        return graph.world(o, r, self.events, scope, at)

    def observation(self, agents: DataFrame, at: str | None = None) -> dict[str, DataFrame]:
        """The world of agents (id) and of whom their Knows edges name, now or at a time."""
        o, r = self.current(at)
        return graph.world(o, r, self.events, graph.observed_scope(r, agents).select("id"), at)

    def chain(self, roots: DataFrame) -> DataFrame:
        return graph.chain(*self.current(), roots)

    def diff(self, start: str, end: str) -> DataFrame:
        """(entry_type, id, created_at, n): what was written in (start, end]."""
        one = lambda name, log: ledger.diff_versions(log, "id", "created_at", start, end).withColumn("entry_type", F.lit(name))
        return one("object", self.objects).unionByName(one("relationship", self.relationships)).select("entry_type", "id", "created_at", "n")

    def status(self) -> DataFrame:
        """(name, n_versions, n_ids)."""
        return ledger.counts(objects=self.objects, relationships=self.relationships, events=self.events)

    def pages(self) -> DataFrame:
        o, r = self.current()
        return docs.pages(o, r, self.evidence)

    def ask(self, question: str, top: int = 5) -> DataFrame:
        """What an answer to a question is to be based on, packed."""
        o, r = self.current()
        return context.question_context(o if "content" in o.columns else o.withColumn("content", F.lit("")), r, question, top)

    def call(self, tool: str, **arguments) -> str:
        """The JSON text of a tool's answer: {"result": [...], "truncated": ...} with at most MOST_LISTED rows, or {"error": ...}."""
        tools = {"search": self.search, "query": self.query, "impact": self.impact, "diff": self.diff, "status": self.status, "ask": self.ask}
        try:
            if tool not in tools:
                raise LookupError(f"unknown tool {tool}")
            rows = tools[tool](**arguments).limit(MOST_LISTED + 1).toJSON().collect()
        except (LookupError, TypeError, ValueError) as e:
            return json.dumps({"error": str(e)})
        return json.dumps({"result": [json.loads(r) for r in rows[:MOST_LISTED]], "truncated": len(rows) > MOST_LISTED})
