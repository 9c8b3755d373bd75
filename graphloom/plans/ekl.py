"""The FIND query language, compiled to one lazy plan.

FIND Object|Relationship [WHERE f op v [AND ...]] [FROM 'name'] [VIA kind] [DEPTH n] [RETURN f, ...] [ORDER BY f [ASC|DESC]] [LIMIT n]
Clauses after WHERE come in any order; a repeated one overwrites, RETURN adds.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from graphloom.operators import graph, search

FIELDS = {"object": ["id", "name", "kind", "evidence", "created_at"], "relationship": ["id", "kind", "from", "to", "created_at"]}
DEFAULTS = {"object": ["id", "name", "kind"], "relationship": ["id", "kind", "from", "to"]}
_TOKEN = re.compile(r"\s*(?:(?P<text>'[^']*')|(?P<number>\d+(?:\.\d+)?)|(?P<word>[^\W\d][\w.]*)|(?P<op>!=|>=|<=|=|>|<)|(?P<comma>,))")


class EklError(ValueError):
    """A query that does not parse, with the character position of the fault."""

    def __init__(self, message: str, position: int):
        super().__init__(f"{message} at {position}")
        self.position = position


class AnchorNotFound(LookupError):
    """FROM names nothing."""


@dataclass
class Query:
    entity: str
    where: list[tuple[str, str, object]] = field(default_factory=list)
    anchor: str | None = None
    via: str | None = None
    depth: int | None = None
    returns: list[str] = field(default_factory=list)
    order: tuple[str, bool] | None = None
    limit: int | None = None


def tokens(text: str) -> list[tuple[str, str, int]]:
    out, i = [], 0
    while text[i:].strip():
        m = _TOKEN.match(text, i)
        if not m:
            raise EklError("unexpected character", i + len(text[i:]) - len(text[i:].lstrip()))
        kind = m.lastgroup
        out.append((kind, m.group(kind), m.start(kind)))
        i = m.end()
    return [*out, ("end", "", len(text))]


def parse(text: str) -> Query:
    ts, i = tokens(text), 0

    def peek(word: str) -> bool:
        return ts[i][0] == "word" and ts[i][1].upper() == word

    def take(kind: str, what: str) -> str:
        nonlocal i
        if ts[i][0] != kind:
            raise EklError(f"expected {what}", ts[i][2])
        i += 1
        return ts[i - 1][1]

    def keyword(word: str) -> None:
        if not peek(word):
            raise EklError(f"expected {word}", ts[i][2])
        take("word", word)

    keyword("FIND")
    at = ts[i][2]
    entity = take("word", "Object or Relationship").lower()
    if entity not in FIELDS:
        raise EklError("expected Object or Relationship", at)
    q = Query(entity)
    if peek("WHERE"):
        i += 1
        while True:
            name, op = take("word", "a field"), None
            if peek("CONTAINS"):
                i, op = i + 1, "contains"
            else:
                op = take("op", "an operator")
            if ts[i][0] not in ("text", "number"):
                raise EklError("expected a value", ts[i][2])
            value: object = ts[i][1][1:-1] if ts[i][0] == "text" else float(ts[i][1])
            i += 1
            q.where.append((name, op, value))
            if not peek("AND"):
                break
            i += 1
    while ts[i][0] != "end":
        if peek("FROM"):
            i += 1
            q.anchor = take("text", "a quoted name")[1:-1]
        elif peek("VIA"):
            i += 1
            q.via = ts[i][1].strip("'") if ts[i][0] in ("word", "text") else None
            if q.via is None:
                raise EklError("expected a kind", ts[i][2])
            i += 1
        elif peek("DEPTH"):
            i += 1
            q.depth = int(float(take("number", "a number")))
        elif peek("LIMIT"):
            i += 1
            q.limit = int(float(take("number", "a number")))
        elif peek("RETURN"):
            i += 1
            q.returns.append(take("word", "a field"))
            while ts[i][0] == "comma":
                i += 1
                q.returns.append(take("word", "a field"))
        elif peek("ORDER"):
            i += 1
            keyword("BY")
            name, up = take("word", "a field"), True
            if peek("ASC") or peek("DESC"):
                up = peek("ASC")
                i += 1
            q.order = (name, up)
        else:
            raise EklError("unexpected text", ts[i][2])
    if q.via and q.anchor is None:
        raise EklError("VIA needs FROM", len(text))
    return q


def _rendered(df: DataFrame, name: str) -> Column:
    """A field as text: arrays joined with commas, times in ISO form."""
    kind = dict(df.dtypes)[name]
    if kind.startswith("array"):
        return F.array_join(name, ",")
    if kind.startswith("timestamp"):
        return F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return F.col(name).cast("string")


def predicate(df: DataFrame, entity: str, name: str, op: str, value: object) -> Column:
    """A comparison; an unknown field makes every operator false, != too; numbers compare only with what reads as a number."""
    if name not in FIELDS[entity]:
        return F.lit(False)
    text = _rendered(df, name)
    no = F.lit(False)
    if op == "contains":
        return F.coalesce(text.contains(value if isinstance(value, str) else f"{value:g}"), no)
    if op in ("=", "!="):
        same = text == value if isinstance(value, str) else text.try_cast("double") == value
        same = F.coalesce(same, no)
        return same if op == "=" else ~same
    number = float(value) if not isinstance(value, str) else None
    if number is None:
        try:
            number = float(value)
        except ValueError:
            return no
    left = text.try_cast("double")
    return F.coalesce({">": left > number, "<": left < number, ">=": left >= number, "<=": left <= number}[op], no)


def run(text: str | Query, objects: DataFrame, relationships: DataFrame) -> DataFrame:
    """The rows of a query over current objects (id, name, kind, evidence, created_at[, content]) and relationships (id, kind, from, to, created_at[, status])."""
    q = parse(text) if isinstance(text, str) else text
    rows = objects if q.entity == "object" else relationships
    if q.anchor is not None:
        named = objects if "content" in objects.columns else objects.withColumn("content", F.lit(""))
        top = search.search(named, q.anchor, 1).collect()
        if not top:
            raise AnchorNotFound(q.anchor)
        root, depth = top[0]["id"], 1 if q.depth is None else q.depth
        if q.via:
            hops = graph.trace(objects, relationships, root, "dependencies", [q.via], depth)
            near = hops.select(F.col("node_id").alias("id")).unionByName(objects.where(F.col("id") == root).select("id"))
            edges = hops.select(F.col("edge_id").alias("id"))
        else:
            near, edges = graph.neighbourhood(objects, relationships, root, depth)
        rows = rows.join((near if q.entity == "object" else edges).select("id").distinct(), "id", "left_semi")
    wanted = q.returns or DEFAULTS[q.entity]
    if q.where:
        rows = rows.where(reduce(lambda a, b: a & b, [predicate(rows, q.entity, *w) for w in q.where]))
    if q.order:
        name, up = q.order
        key = _rendered(rows, name) if name in FIELDS[q.entity] else F.lit(None).cast("string")
        rows = rows.orderBy(key.asc_nulls_last() if up else key.desc_nulls_first(), "id")
    if q.limit is not None:
        rows = rows.limit(q.limit)
    return rows.select(*[F.col(c) if c in FIELDS[q.entity] else F.lit(None).cast("string").alias(c) for c in dict.fromkeys(wanted)])
