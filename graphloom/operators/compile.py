"""Semantic compilation: unions, merges, relationship dedupe, the canonical model, validation, roll-ups, incremental passes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, functions as F


def union(graphs: list[DataFrame]) -> DataFrame:
    """All rows of all graphs, repeated ones too."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), graphs)


def apply_merges(objects: DataFrame, relationships: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Objects without merged members and relationships between canonical ids, deduplicated; merges has (id, canonical_id)."""
    m = merges.where("id <> canonical_id").select("id", "canonical_id")
    kept = objects.join(m.select("id"), "id", "left_anti")
    moved = relationships
    for end in ("from", "to"):
        moved = moved.join(m.select(F.col("id").alias(end), F.col("canonical_id").alias("_c")), end, "left").withColumn(end, F.coalesce("_c", end)).drop("_c")
    return kept, dedupe_relationships(moved.select(relationships.columns))


def dedupe_relationships(relationships: DataFrame) -> DataFrame:
    """One row a (from, to, kind): the first by (created_at, id), with the evidence of all in first-seen order."""
    order = [F.col("created_at"), F.col("id")]
    rest = [c for c in relationships.columns if c not in ("from", "to", "kind", "evidence")]
    seen = F.array_sort(F.collect_list(F.struct(*order, F.coalesce("evidence", F.array().cast("array<string>")).alias("e"))))
    grouped = relationships.groupBy("from", "to", "kind").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_f"), F.array_distinct(F.flatten(F.transform(seen, lambda x: x["e"]))).alias("evidence"))
    return grouped.select("from", "to", "kind", "evidence", *[F.col(f"_f.{c}").alias(c) for c in rest])


def canonical_model(objects: DataFrame, evidence: DataFrame) -> DataFrame:
    """Objects with their evidence embedded, by confidence from high to low (clamped to 0..1, ties by place in the list), and the top fragment as description; ids without evidence row fall away."""
    one = evidence.select("id", "fragment", F.least(F.greatest(F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("confidence")).groupBy("id").agg(F.min(F.struct("confidence", "fragment")).alias("v")).select("id", "v.fragment", "v.confidence")
    listed = objects.select(F.col("id").alias("_o"), F.posexplode("evidence").alias("_p", "id")).join(one, "id")
    packed = listed.groupBy("_o").agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("k"), F.col("_p").alias("p"), "id", "fragment", "confidence"))).alias("_e"))
    out = objects.drop("evidence").join(packed, F.col("id") == F.col("_o"), "left")
    return out.withColumn("evidence", F.transform("_e", lambda x: F.struct(x["id"].alias("id"), x["fragment"].alias("fragment"), x["confidence"].alias("confidence")))).withColumn("primary_description", F.try_element_at("_e", F.lit(1))["fragment"]).drop("_e", "_o")


def validate(objects: DataFrame, relationships: DataFrame) -> DataFrame:
    """(problem, id): duplicate object ids, and relationships whose from or to is no object, one row an end."""
    twice = objects.groupBy("id").count().where("count > 1").select(F.lit("duplicate").alias("problem"), "id")
    ids = objects.select("id").distinct()
    lost = [relationships.join(ids.withColumnRenamed("id", end), end, "left_anti").select(F.lit(f"dangling {end}").alias("problem"), "id") for end in ("from", "to")]
    return union([twice, *lost])


def rollups(files: DataFrame, relationships: DataFrame, depth: int = 3) -> DataFrame:
    """(group_key, n_members, n_boundary) of files (id, path[, project]): project:<name>, else dir:<first path components>.

    Groups of two members or more, if there are two such groups or more altogether; n_boundary counts, per member, relationships with the other end outside its group.
    """
    project = F.col("project") if "project" in files.columns else F.lit(None).cast("string")
    key = F.coalesce(F.concat(F.lit("project:"), project), F.concat(F.lit("dir:"), F.array_join(F.slice(F.split("path", "/"), 1, depth), "/")))
    members = files.select("id", key.alias("group_key")).where("group_key is not null").dropDuplicates(["id"])
    sizes = members.groupBy("group_key").agg(F.count(F.lit(1)).alias("n_members")).where("n_members >= 2")
    enough = sizes.agg((F.count(F.lit(1)) >= 2).alias("ok"))
    inside = members.join(sizes, "group_key").select("id", "group_key")
    ends = relationships.select("id", "from", "to").dropDuplicates(["id"])
    a = inside.select(F.col("id").alias("from"), F.col("group_key").alias("ga"))
    b = inside.select(F.col("id").alias("to"), F.col("group_key").alias("gb"))
    both = ends.join(a, "from", "left").join(b, "to", "left").where("not (ga <=> gb)")
    crossing = both.select(F.explode(F.array("ga", "gb")).alias("group_key")).where("group_key is not null").groupBy("group_key").agg(F.count(F.lit(1)).alias("n_boundary"))
    out = sizes.join(crossing, "group_key", "left").select("group_key", "n_members", F.coalesce("n_boundary", F.lit(0)).alias("n_boundary"))
    return out.crossJoin(F.broadcast(enough)).where("ok").drop("ok")  # enough is one row


class Passes:
    """Passes with dependencies: an order, levels that could run at once, and results kept by content key."""

    def __init__(self) -> None:
        self.passes: dict[str, tuple[list[str], Callable[..., DataFrame]]] = {}

    def add(self, name: str, needs: list[str], run: Callable[..., DataFrame]) -> None:
        self.passes[name] = (needs, run)

    def levels(self) -> list[list[str]]:
        left, done, out = dict(self.passes), set(), []
        while left:
            ready = sorted(n for n, (needs, _) in left.items() if set(needs) <= done)
            if not ready:
                raise ValueError(f"passes need each other: {sorted(left)}")
            out.append(ready)
            done |= set(ready)
            for n in ready:
                del left[n]
        return out

    def order(self) -> list[str]:
        return [n for level in self.levels() for n in level]

    def run(self, kept: dict[str, tuple[str, DataFrame]] | None = None, keys: dict[str, str] | None = None) -> dict[str, DataFrame]:
        """All results; a pass whose key equals the kept one is not run again."""
        out: dict[str, DataFrame] = {}
        for name in self.order():
            needs, run = self.passes[name]
            key = (keys or {}).get(name)
            if kept is not None and key is not None and name in kept and kept[name][0] == key:
                out[name] = kept[name][1]
            else:
                out[name] = run(*[out[n] for n in needs])
                if kept is not None and key is not None:
                    kept[name] = (key, out[name])
        return out
