"""Schemas that drift between files (problem 5).

The header of each body (its top-level fields with type and content) is read in parallel. Headers fold through a type-promotion
lattice into the union schema all files are cast to. Differences are logged in the order of each feed: a chunk of a feed (its batches in one
range partition of all headers) needs only the header before it and the last and next value of each field, which are folded over the chunks' summaries.

Scale: no task holds more than one chunk of one feed, or one summary a chunk; ranges are cut by size, so a feed with a third of all files has as many
chunks as its share asks for, whatever its batch ids look like. Results do not depend on where the chunks end.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from graphloom.session import cut

_HEADER = "feed string, batch_id string, fields array<struct<field:string,type:string,content:string>>"
#: The JSON types and the column type each is read as; types that meet otherwise are read as JSON text.
LATTICE = {"null": "void", "boolean": "boolean", "number": "double", "string": "string", "array": "json", "object": "json"}
#: The fields that get a column of their own; the values of rarer ones share a map.
MOST_COLUMNS = 1000


def json_type(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return "string" if isinstance(value, str) else "array" if isinstance(value, list) else "object"


def _no_constant(name: str) -> object:
    raise ValueError(name)


def read_body(body: str | None) -> dict | None:
    """The fields of a readable body, else None: a body is readable if it is a JSON object."""
    try:
        value = json.loads(body, parse_constant=_no_constant) if body else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def header(fields: dict) -> list[tuple[str, str, str | None]]:
    """(field, type, content) in the order of names."""
    out = []
    for name in sorted(fields):
        value = fields[name]
        text = None if value is None else value if isinstance(value, str) else json.dumps(value, sort_keys=True)
        out.append((name, json_type(value), text))
    return out


def promote(a: str, b: str) -> str:
    """The least column type that holds both: void is below all, json above all, boolean and double meet in string."""
    if a == b or b == "void":
        return a
    if a == "void":
        return b
    return "json" if "json" in (a, b) else "string"


def headers(manifests: DataFrame) -> DataFrame:
    """One header for each feed and batch of readable bodies; of bodies with equal batch_ids the one with the smallest text counts."""

    def run(batches):
        for pdf in batches:
            out = []
            for feed, batch, body in zip(pdf["feed"], pdf["batch_id"], pdf["body"]):
                if (fields := read_body(body)) is not None:
                    out.append((feed, batch, [dict(zip(("field", "type", "content"), f)) for f in header(fields)]))
            yield pd.DataFrame(out, columns=["feed", "batch_id", "fields"])

    rows = manifests.select("feed", "batch_id", "body").where("feed is not null and batch_id is not null and body is not null").mapInPandas(run, _HEADER)
    return rows.groupBy("feed", "batch_id").agg(F.min("fields").alias("fields"))


_NUMBER = re.compile(r"-?\d+(?:\.\d+)?")
_STEM = re.compile(r"[A-Z]?[a-z]+|\d+|[A-Z]+")


def stems(field: str) -> set[str]:
    """The words of a field name without plural endings and counting words."""
    words = (re.sub(r"(ies|y)$", "i", re.sub(r"(?<=[a-z]{3})s$", "", w.lower())) for w in _STEM.findall(field))
    return {w for w in words if w not in {"n", "num", "count", "row", "total", "nr", "name", "by", "id", "at", "i"}} or {field.lower()}


def continues(old: tuple[str, str | None], new: tuple[str, str | None], names: tuple[str, str]) -> float:
    """How well a new field's (type, content) goes on that of one that vanished, 0 for not at all.

    Types must agree where both are known. Equal contents do, as do numbers close by (also within strings, arrays and objects) and texts with
    the same first word; short or small contents only with a word of the names in common.
    """
    (a, x), (b, y) = old, new
    if "null" not in (a, b) and a != b:
        return 0.0
    left, right = stems(names[0]), stems(names[1])
    shared = 1.0 if left & right or any(p[:5] == q[:5] for p in left for q in right) else 0.0
    if a == "null" or b == "null" or x is None or y is None:
        return shared
    if a == "boolean":
        return shared * (1.0 + (x == y))
    if x == y and (len(x) > 6 or a in ("array", "object")):
        return 3.0 + shared
    p, q = [float(n) for n in _NUMBER.findall(x)], [float(n) for n in _NUMBER.findall(y)]
    same_text = _NUMBER.sub("#", x) == _NUMBER.sub("#", y)
    if same_text and p and len(p) == len(q):
        gap = max(abs(m - n) for m, n in zip(p, q))
        size = max(abs(m) for m in [*p, *q])
        if size >= 100 and gap <= max(60, 0.05 * size):
            return 2.0 - gap / (gap + 20) + shared
        if re.match(r"[A-Za-z]{3}", x):
            return 2.0 + shared
        return shared * 1.5 if gap <= max(5, 0.5 * size) else 0.0
    return shared * 0.5


def renames(gone: dict[str, tuple], come: dict[str, tuple]) -> list[tuple[str, str]]:
    """(old, new) pairs, each name once, the surest first."""
    scored = sorted(((continues(gone[o], come[n], (o, n)), o, n) for o in gone for n in come), key=lambda s: (-s[0], s[1], s[2]))
    used: set = set()
    out = []
    for score, o, n in scored:
        if score > 0 and ("-", o) not in used and ("+", n) not in used:
            used |= {("-", o), ("+", n)}
            out.append((o, n))
    return out


def step(before: dict, last: dict, now: dict, ahead: dict) -> list[tuple[str, str]]:
    """(field, change_kind) between two headers; last has the last non-null (type, content) of each field, ahead the next."""
    gone = {f: last.get(f, before[f]) for f in before if f not in now}
    come = {f: ahead.get(f, v) if v[0] == "null" else v for f, v in now.items() if f not in before}
    moved = renames(gone, come)
    olds, news = {o for o, _ in moved}, {n for _, n in moved}
    out = [(o, "renamed") for o in olds] + [(f, "removed") for f in gone if f not in olds] + [(f, "added") for f in come if f not in news]
    out += [(f, "retyped") for f, (kind, _) in now.items() if kind != "null" and f not in news and f in last and last[f][0] != kind]
    return out


def _fields(row) -> dict[str, tuple]:
    return {f["field"]: (f["type"], f["content"]) for f in row}


def changes(manifests: DataFrame, partitions: int | None = None) -> DataFrame:
    """(feed, batch_id, field, change_kind): the differences of each readable body to the one before it in its feed.

    Unreadable and null bodies, and rows without feed or batch_id, are passed over; equal batch_ids are one. The first body of a feed has no
    changes. An empty table gives no rows; extra columns are ignored.
    """
    by = [F.col("feed"), F.col("batch_id")]
    ranged = cut(headers(manifests)).repartitionByRange(partitions, *by) if partitions else cut(headers(manifests)).repartitionByRange(*by)
    chunks = cut(ranged.withColumn("chunk", F.spark_partition_id()))

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        first: dict[str, tuple] = {}
        last: dict[str, tuple] = {}
        ordered = pdf.sort_values("batch_id")
        for row in ordered["fields"]:
            known = {f: v for f, v in _fields(row).items() if v[0] != "null"}
            first, last = known | first, last | known
        shown = (json.dumps(_fields(ordered["fields"].iloc[-1])), json.dumps(last), json.dumps(first))
        return pd.DataFrame([(pdf["feed"].iloc[0], int(pdf["chunk"].iloc[0]), *shown)], columns=["feed", "chunk", "before", "last", "ahead"])

    def carried(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values("chunk")
        nexts, ahead = [], {}
        for first in reversed(ordered["ahead"].tolist()):
            nexts.append(json.dumps(ahead))
            ahead = ahead | json.loads(first)
        out, before, last = [], None, {}
        for row, after in zip(ordered.itertuples(index=False), reversed(nexts)):
            out.append((row.feed, row.chunk, before, json.dumps(last), after))
            before, last = row.before, last | json.loads(row.last)
        return pd.DataFrame(out, columns=["feed", "chunk", "before", "last", "ahead"])

    def log(pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        out = []
        before = start["before"].iloc[0] if len(start) else None
        before = {f: tuple(v) for f, v in json.loads(before).items()} if isinstance(before, str) else None
        last = {f: tuple(v) for f, v in json.loads(start["last"].iloc[0]).items()} if len(start) else {}
        rows = [(b, _fields(f)) for b, f in pdf.sort_values("batch_id")[["batch_id", "fields"]].itertuples(index=False)]
        nexts: list[dict] = [{f: tuple(v) for f, v in json.loads(start["ahead"].iloc[0]).items()} if len(start) else {}]
        for _, now in reversed(rows):
            nexts.append(nexts[-1] | {f: v for f, v in now.items() if v[0] != "null"})
        for (batch, now), ahead in zip(rows, reversed(nexts[1:])):
            if before is not None:
                out += [(pdf["feed"].iloc[0], batch, f, kind) for f, kind in step(before, last, now, ahead)]
            last |= {f: v for f, v in now.items() if v[0] != "null"}
            before = now
        return pd.DataFrame(out, columns=["feed", "batch_id", "field", "change_kind"])

    state = "feed string, chunk int, before string, last string, ahead string"
    starts = chunks.groupBy("feed", "chunk").applyInPandas(summary, state).groupBy("feed").applyInPandas(carried, state)
    return chunks.groupBy("feed", "chunk").cogroup(starts.groupBy("feed", "chunk")).applyInPandas(lambda a, b: log(a, b), "feed string, batch_id string, field string, change_kind string")


def union_schema(manifests: DataFrame) -> DataFrame:
    """(field, column_type, n_bodies, n_nulls): every top-level field with the type that the lattice promotes its values to."""
    rank = F.create_map(*[x for k, v in LATTICE.items() for x in (F.lit(k), F.lit(v))])
    fields = headers(manifests).select(F.explode("fields").alias("f")).select("f.field", rank[F.col("f.type")].alias("t"), (F.col("f.type") == "null").cast("bigint").alias("z"))
    kinds = fields.groupBy("field").agg(F.array_sort(F.collect_set("t")).alias("ts"), F.count(F.lit(1)).alias("n_bodies"), F.sum("z").alias("n_nulls"))
    folded = F.aggregate("ts", F.lit("void"), lambda a, b: F.when((a == b) | (b == "void"), a).when(a == "void", b).when((a == "json") | (b == "json"), "json").otherwise("string"))
    return kinds.select("field", folded.alias("column_type"), "n_bodies", "n_nulls")


def _text(kind: str, c: Column) -> Column:
    return c.cast("boolean") if kind == "boolean" else c.cast("double") if kind == "double" else c


def consistent_table(manifests: DataFrame, most: int = MOST_COLUMNS) -> DataFrame:
    """All readable bodies as one table: manifest_id, feed, batch_id and one column a field, named f_<field>, of its promoted type.

    Missing and null values are null; values of fields that hold arrays or objects anywhere are JSON text. Where there are more than most fields, those of
    most bodies have columns and the JSON texts of all others are in the map rest.
    """
    known = union_schema(manifests).orderBy(F.desc("n_bodies"), "field").limit(most + 1).collect()
    kinds = {r["field"]: r["column_type"] for r in sorted(known[:most], key=lambda r: r["field"])}
    more = len(known) > most

    def run(batches):
        for pdf in batches:
            out = []
            for i, feed, batch, body in zip(pdf["manifest_id"], pdf["feed"], pdf["batch_id"], pdf["body"]):
                fields = read_body(body)
                if fields is None:
                    continue
                row = {f: None if v is None else v if isinstance(v, str) and kinds.get(f, "json") != "json" else json.dumps(v, sort_keys=True) for f, v in fields.items()}
                out.append((i, feed, batch, row))
            yield pd.DataFrame(out, columns=["manifest_id", "feed", "batch_id", "values"])

    rows = manifests.select("manifest_id", "feed", "batch_id", "body").mapInPandas(run, "manifest_id bigint, feed string, batch_id string, values map<string,string>")
    rest = [F.map_filter("values", lambda k, _: ~k.isin(list(kinds))).alias("rest")] * more
    return rows.select("manifest_id", "feed", "batch_id", *[_text(k, F.col("values")[f]).alias(f"f_{f}") for f, k in kinds.items()], *rest)
