"""Context for questions: packing under a budget, citations, the query gate, schema prompts."""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F

BUDGET = 200_000


def pack(items: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(group_id, item_id, position): of items (group_id, position, item_id, n_chars) those taken in order while they fit; the first is always taken, a too large one is skipped.

    Items repeat under their first position only. Each group is one answer's context, bounded by its search and neighbourhood limits.
    """
    once = items.groupBy("group_id", "item_id").agg(F.min(F.struct("position", "n_chars")).alias("v"))
    listed = once.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct(F.col("v.position").alias("position"), "item_id", F.col("v.n_chars").alias("n_chars")))).alias("items"))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<struct<position:bigint,item_id:string>>").alias("taken"))

    def step(acc, x):
        fits = (F.size(acc["taken"]) == 0) | (acc["used"] + x["n_chars"] <= budget)
        one = F.array(F.struct(x["position"].cast("bigint").alias("position"), x["item_id"].cast("string").alias("item_id")))
        return F.struct(F.when(fits, acc["used"] + x["n_chars"]).otherwise(acc["used"]).cast("bigint").alias("used"), F.when(fits, F.concat(acc["taken"], one)).otherwise(acc["taken"]).alias("taken"))

    return listed.select("group_id", F.explode(F.aggregate("items", start, step, lambda a: a["taken"])).alias("t")).select("group_id", "t.item_id", "t.position")


def question_context(objects: DataFrame, relationships: DataFrame, question: str, top: int = 5, depth: int = 1, budget: int = BUDGET) -> DataFrame:
    """(group_id, item_id, position) of the context of a question: the best matches of objects (id, name, kind, content), each followed by its neighbourhood by hop and id, packed under the budget.

    An item's size is that of its name and content. Matches and hops bound what is packed.
    """
    from functools import reduce

    from graphloom.operators import graph, search

    found = search.ask(objects, question, top).collect()
    none = objects.select("id").limit(0).select(F.lit(0).alias("m"), F.lit(0).alias("hop"), F.col("id").alias("item_id"))
    near = [graph.neighbourhood(objects, relationships, r["id"], depth)[0].select(F.lit(i).alias("m"), "hop", F.col("id").alias("item_id")) for i, r in enumerate(found)]
    first = reduce(DataFrame.unionByName, near, none).groupBy("item_id").agg(F.min(F.struct("m", "hop")).alias("at"))
    sized = first.join(objects.select(F.col("id").alias("item_id"), (F.char_length(F.coalesce("name", F.lit(""))) + F.char_length(F.coalesce("content", F.lit("")))).alias("n_chars")), "item_id")
    ranked = sized.select(F.lit(question).alias("group_id"), "item_id", "n_chars", (F.col("at.m") * (depth + 1) + F.col("at.hop")).cast("bigint").alias("position"))
    return pack(ranked, budget)


def cited(answers: DataFrame, known: DataFrame) -> DataFrame:
    """(answer_id, position, citation): the known (id) citations of the last JSON object of each answer (answer_id, content), once each, in order."""

    @F.pandas_udf("array<string>")
    def listed(contents: pd.Series) -> pd.Series:
        return pd.Series([_listed(c) if isinstance(c, str) else [] for c in contents])

    rows = answers.select("answer_id", F.posexplode(listed("content")).alias("position", "citation"))
    return rows.join(known.select(F.col("id").alias("citation")).distinct(), "citation", "left_semi").select("answer_id", "position", "citation")


def _listed(content: str) -> list[str]:
    at = content.rfind("{")
    while at >= 0:
        try:
            found = json.JSONDecoder().raw_decode(content[at:])[0]
            return list(dict.fromkeys(str(i) for i in found.get("citations", []))) if isinstance(found, dict) else []
        except ValueError:
            at = content.rfind("{", 0, at)
    return []


def citations(content: str, known: set[str]) -> tuple[str, list[str]]:
    """(text before, known ids) of the last JSON object in an answer; what is no such object leaves the answer as it is."""
    at = content.rfind("{")
    while at >= 0:
        try:
            found = json.JSONDecoder().raw_decode(content[at:])[0]
            ids = found.get("citations", []) if isinstance(found, dict) else []
            return content[:at].rstrip(), [i for i in dict.fromkeys(ids) if i in known]
        except ValueError:
            at = content.rfind("{", 0, at)
    return content, []


def select_only(spark, sql: str, most: int = 1000) -> str:
    """The statement, with LIMIT if it had none; raises ValueError unless it is exactly one query."""
    bare = re.sub(r"--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S).strip().rstrip(";").strip()
    if not bare or ";" in re.sub(r"'(?:[^']|'')*'", "", bare):
        raise ValueError("exactly one statement is wanted")
    if not re.match(r"(?i)(select|with)\b", bare):
        raise ValueError("only queries are allowed")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(bare).treeString()
    if re.search(r"\b(?:Insert\w*|\w+Command|Create\w+|Drop\w+|Merge\w+|Update\w+|Delete\w+)\b", plan):
        raise ValueError("only queries are allowed")
    return bare if re.search(r"(?i)\blimit\s+\d+\s*$", bare) else f"{bare} LIMIT {most}"


def schema_prompt(tables: dict[str, list[tuple[str, str]]]) -> str:
    return "\n".join(f"{t}({', '.join(f'{c} {k}' for c, k in columns)})" for t, columns in sorted(tables.items()))


def audit_rows(database: str, question: str, sql: str, rows: list, at: str) -> tuple[dict, dict]:
    """(event, evidence) that record a query that was run: the event names the evidence, whose fragment is the statement and the hash of its result."""
    seen = audit_event(database, question, sql, rows)
    evidence = {"id": hashlib.sha256(f"{at}|{sql}|{seen['result_hash']}".encode()).hexdigest()[:32], "path": database, "fragment": f"{sql} -> {seen['result_hash']}", "confidence": 1.0, "created_at": at}
    return {"kind": "QueryExecuted", "payload": json.dumps(seen, sort_keys=True), "evidence": [evidence["id"]], "occurred_at": at}, evidence


def schema_rows(tables: DataFrame, source_system: str | None = None) -> DataFrame:
    """(line): a line name(column type, ...) for each table (table_name, source_system, columns of (name, data_type)) of a system, of any where none is named."""
    rows = tables if source_system is None else tables.where(F.col("source_system") == source_system)
    cols = F.array_join(F.transform("columns", lambda c: F.concat_ws(" ", c["name"], c["data_type"])), ", ")
    return rows.select(F.concat("table_name", F.lit("("), cols, F.lit(")")).alias("line"))


def audit_event(database: str, question: str, sql: str, rows: list) -> dict:
    """What is recorded of a query that was run: never its rows, only their hash."""
    return {"database": database, "question": question, "sql": sql, "n_rows": len(rows), "result_hash": hashlib.sha256(json.dumps(rows, sort_keys=True, default=str).encode()).hexdigest()}
