"""Consolidating pairwise matches into groups (problem 6).

The component of the vertex with the most links is peeled first, by breadth-first joins of a frontier with the links; what it
reached is one group and leaves by anti-join. On the rest each vertex takes the smallest id among itself and its neighbours
(minimum propagation), the pointers are followed to their ends by doubling, and links between the ends go on to the next round,
which has the local minima only.

Once at most BUCKET links are left, one task propagates the minima on arrays.

Scale: links stay distributed; a vertex with a third of all links costs one row after the map-side minimum. Rounds are
logarithmic, and each is written to the checkpoint folder. If the peeled component is deeper than MAX_HOPS, its reached part
goes on as one vertex, so nothing is lost.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from graphloom.functions.ids import canonical_uuid
from graphloom.session import cut

MAX_HOPS = 8
BUCKET = 200_000


def _both(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _reached(links: DataFrame, start: str, max_hops: int) -> DataFrame:
    """(v): what breadth-first joins reach from start in at most max_hops."""
    spark = links.sparkSession
    both = _both(links)
    frontier = spark.createDataFrame([(start,)], "v string")
    seen = frontier
    for _ in range(max_hops):
        frontier = cut(both.join(frontier.withColumnRenamed("v", "u"), "u", "left_semi").select("v").distinct().join(seen, "v", "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return cut(seen)


def _ends(pointers: DataFrame) -> DataFrame:
    """Pointers u -> v to smaller ids, each followed to its end."""
    while True:
        for _ in range(2):
            nxt = pointers.select(F.col("u").alias("v"), F.col("v").alias("w"))
            pointers = pointers.join(nxt, "v", "left").select("u", F.coalesce("w", "v").alias("v"))
        pointers = cut(pointers)
        if pointers.join(pointers.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            return pointers


def propagate(a: list, b: list) -> pd.DataFrame:
    """Minimum propagation with pointer jumping over links that fit one task: (u, v) as smallest_labels."""
    codes, names = pd.factorize(np.array([*a, *b], dtype=object), sort=True)  # codes in the order of the names
    left, right = codes[: len(a)], codes[len(a) :]
    label = np.arange(len(names))
    while True:
        before = label.copy()
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        np.minimum.at(label, before[left], low)
        np.minimum.at(label, before[right], low)
        label = label[label]
        if (label == before).all():
            moved = label != np.arange(len(names))
            return pd.DataFrame({"u": names[moved], "v": names[label[moved]]})


def smallest_labels(links: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(u, v): every vertex of links (a, b) but the smallest of each component, with that smallest vertex."""
    maps = []
    links = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while n := links.count():
        if n <= bucket:
            maps.append(links.groupBy(F.lit(0).alias("one")).applyInPandas(lambda p: propagate(p["a"].tolist(), p["b"].tolist()), "u string, v string"))
            break
        low = _both(links).groupBy("u").agg(F.min("v").alias("v")).where("v < u")
        ends = _ends(low)
        maps.append(ends)
        for end in ("a", "b"):
            links = links.join(ends.select(F.col("u").alias(end), F.col("v").alias("to")), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        links = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if not maps:
        return links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    total = maps.pop()
    while maps:
        first = maps.pop()
        on = total.select(F.col("u").alias("v"), F.col("v").alias("w"))
        total = cut(first.join(on, "v", "left").select("u", F.coalesce("w", "v").alias("v")).unionByName(total))
    return total


def components(links: DataFrame, max_hops: int = MAX_HOPS, bucket: int = BUCKET) -> DataFrame:
    """(u, v) as smallest_labels, with the component of the vertex of most links peeled first."""
    links = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    top = _both(links).groupBy("u").count().orderBy(F.desc("count"), "u").limit(1).collect()
    if not top:
        return links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    seen = _reached(links, top[0]["u"], max_hops)
    low = seen.agg(F.min("v")).collect()[0][0]
    inside = seen.withColumn("in", F.lit(True))
    ends = links.join(inside.select(F.col("v").alias("a"), F.col("in").alias("ia")), "a", "left").join(inside.select(F.col("v").alias("b"), F.col("in").alias("ib")), "b", "left")
    rest = ends.where("ia is null or ib is null").select(F.when(F.col("ia"), F.lit(low)).otherwise(F.col("a")).alias("a"), F.when(F.col("ib"), F.lit(low)).otherwise(F.col("b")).alias("b"))
    labels = cut(smallest_labels(rest, bucket))
    peeled = seen.where(F.col("v") != low).select(F.col("v").alias("u"), F.lit(low).alias("v"))
    up = labels.where(F.col("u") == low).select(F.col("u").alias("v"), F.col("v").alias("w"))
    return peeled.join(up, "v", "left").select("u", F.coalesce("w", "v").alias("v")).unionByName(labels)


def groups(candidates: DataFrame, threshold: float = 0.9, max_hops: int = MAX_HOPS, bucket: int = BUCKET) -> DataFrame:
    """(record_id, group_id) for every distinct non-null id in a_id or b_id.

    Rows with both ends and a confidence of at least threshold link their ends, directly or through others; group_id is the smallest
    record_id of the group, the record itself if unlinked. Null and NaN confidences link nothing; values over 1 count as any other. Self
    pairs, repeated and reversed pairs change nothing. An empty table gives no rows.
    """
    pairs = candidates.select(canonical_uuid("a_id").alias("a"), canonical_uuid("b_id").alias("b"), "confidence")
    sure = F.col("confidence") >= F.lit(threshold).cast(candidates.schema["confidence"].dataType)
    labels = components(pairs.where(sure & ~F.isnan("confidence") & F.col("a").isNotNull() & F.col("b").isNotNull()).select("a", "b"), max_hops, bucket)
    every = pairs.select(F.explode(F.array("a", "b")).alias("record_id")).where("record_id is not null").distinct()
    return every.join(labels.select(F.col("u").alias("record_id"), F.col("v").alias("to")), "record_id", "left").select("record_id", F.coalesce("to", "record_id").alias("group_id"))
