"""The graph's four tables in the shape the operators take, from stored tables with UUIDs in any spelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from graphloom.functions.ids import canonical_uuid
from graphloom.operators.ledger import latest


def object_versions(objects: DataFrame, *more: Column) -> DataFrame:
    """(id, name, kind, evidence, created_at, status, sig, more): every row as a version, sig its content without created_at."""
    entries = F.array_join(F.array_sort(F.transform(F.map_entries("props"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    sig = F.concat_ws("|", F.coalesce("obj_name", F.lit("")), F.coalesce("kind", F.lit("")), F.coalesce(entries, F.lit("")), F.coalesce(F.array_join("evidence", ",", "-"), F.lit("")))
    return objects.where("id is not null").select(canonical_uuid("id").alias("id"), F.col("obj_name").alias("name"), "kind", "evidence", "created_at", F.trim(F.col("props")["status"], F.lit('"')).alias("status"), sig.alias("sig"), *more)


def current_objects(objects: DataFrame, *more: Column) -> DataFrame:
    """The latest version of each object, ties by content."""
    return latest(object_versions(objects, *more), "id", ["created_at", "sig"])


def columns(props: Column) -> Column:
    """(name, data_type) of each entry of the JSON list columns, which holds names or objects with a name; null without such a list."""
    entry = lambda c: F.when(c.startswith("{"), F.struct(F.get_json_object(c, "$.name").alias("name"), F.get_json_object(c, "$.data_type").alias("data_type"))).otherwise(F.struct(c.alias("name"), F.lit(None).cast("string").alias("data_type")))
    return F.filter(F.transform(F.from_json(props["columns"], "array<string>"), entry), lambda c: c["name"].isNotNull())


def structured_objects(objects: DataFrame) -> DataFrame:
    """current_objects with the lower-cased names of their columns and texts of their row cells, sorted and distinct; null where there are none."""
    some = lambda a: F.when(F.size(a) > 0, F.array_sort(F.array_distinct(a)))
    rows = F.transform(F.from_json(F.col("props")["rows"], "array<string>"), lambda r: F.coalesce(F.from_json(r, "array<string>"), F.array().cast("array<string>")))
    cells = F.filter(F.transform(F.flatten(rows), lambda c: F.lower(F.trim(c))), lambda c: c.isNotNull() & (c != ""))
    return current_objects(objects, some(F.transform(columns(F.col("props")), lambda c: F.lower(c["name"]))).alias("columns"), some(cells).alias("cells"))


def current_endpoints(objects: DataFrame) -> DataFrame:
    """(id, kind, name, columns): current objects that stand for a table of some system, which are tables and Source and Sink nodes with the name they read or write."""
    value = lambda k: F.trim(F.col("props")[k], F.lit('"'))
    o = current_objects(objects, columns(F.col("props")).alias("columns"), value("node_type").alias("node_type"), value("object_name").alias("object_name"))
    node = (F.col("kind") == "TransformNode") & F.col("node_type").isin("Source", "Sink") & (F.col("object_name") != "")
    return o.where((F.col("kind") == "Table") | node).select("id", "kind", F.when(F.col("kind") == "Table", F.col("name")).otherwise(F.col("object_name")).alias("name"), "columns")


def relationship_rows(relationships: DataFrame) -> DataFrame:
    """(id, kind, from, to, evidence, created_at, status) with canonical ids."""
    return relationships.where("id is not null").select(
        canonical_uuid("id").alias("id"), "kind", canonical_uuid("from_id").alias("from"), canonical_uuid("to_id").alias("to"), F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"), "created_at", F.trim(F.col("props")["status"], F.lit('"')).alias("status")
    )


def current_relationships(relationships: DataFrame) -> DataFrame:
    """The latest row of each relationship, ties by ends."""
    return latest(relationship_rows(relationships), "id", ["created_at", "from", "to"])
