"""Parent-child links to full hierarchies (problem 3).

A weighted disjoint-set forest per bucket of links joins each child to the topmost node known in the bucket, with its distance
as offset. Links between the topmost nodes of different buckets (the interface) are merged the same way, in ever fewer
buckets, until the interface fits one bucket; while it does not, a join doubles the length of every interface link first.
A link whose parent's root is the child itself closes a cycle. A contracted link carries the smallest id of the nodes it stands for, so that
a cycle over several buckets still knows its smallest node.

Scale: every child has one link, so buckets hash evenly however many children a parent has; a bucket has about BUCKET links.
Paths are read off by walking the bucket's parent index, then joined with the path of the bucket's root.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from graphloom.functions.ids import canonical_uuid
from graphloom.session import cut

BUCKET = 60_000
_FOREST = "child string, root string, offset bigint, cyclic boolean, low string"


def contains_links(relationships: DataFrame, kind: str = "contains") -> DataFrame:
    """(child, parent): one row for each child of a link of this kind whose ends are not null.

    Kinds compare without case. Repeated links and one link under several ids count once; of several parents the smallest is kept.
    """
    return (
        relationships.where((F.lower(F.trim("kind")) == kind) & F.col("from_id").isNotNull() & F.col("to_id").isNotNull())
        .select(canonical_uuid("to_id").alias("child"), canonical_uuid("from_id").alias("parent"))
        .groupBy("child")
        .agg(F.min("parent").alias("parent"))
    )


def forest(children: list[str], parents: list[str], weights: list[int], lows: list[str], with_path: bool = False) -> pd.DataFrame:
    """The disjoint-set forest of links that name each child once; lows has the smallest node each link stands for, its parent left out.

    root is the topmost node reached, offset the distance to it and low the smallest node on the way, the root left out; on a cycle or below one,
    cyclic is set, root is the cycle's smallest node and offset -1. path has the nodes from the child up to, but without, the root; empty where cyclic.
    """
    up: dict[str, tuple[str, int, str]] = {}
    direct = dict(zip(children, parents))
    own = dict(zip(children, lows))
    closing: set[str] = set()

    def find(x: str) -> tuple[str, int, str | None]:
        trail = []
        while x in up:
            trail.append(x)
            x = up[x][0]
        total, low = 0, None
        for y in reversed(trail):
            total += up[y][1]
            low = up[y][2] if low is None else min(low, up[y][2])
            up[y] = (x, total, low)
        return x, total, low

    for child, parent, weight, mine in zip(children, parents, weights, lows):
        root, offset, low = find(parent)
        if root == child:
            closing.add(child)
        else:
            up[child] = (root, offset + weight, mine if low is None else min(mine, low))
    smallest = {}
    for start in closing:
        low, at = own[start], direct[start]
        while at != start:
            low, at = min(low, own[at]), direct[at]
        smallest[start] = low
    out = []
    for child in children:
        root, offset, low = find(child)
        if root in smallest:
            out.append((child, smallest[root], -1, True, None))
        else:
            out.append((child, root, offset, False, low))
    frame = pd.DataFrame(out, columns=["child", "root", "offset", "cyclic", "low"])
    if with_path:
        paths = []
        for child, root, _, cyclic, _ in out:
            path = []
            while not cyclic and child != root:
                path.append(child)
                child = direct[child]
            paths.append(path)
        frame["path"] = paths
    return frame


def _local(links: DataFrame, buckets: int, with_path: bool) -> DataFrame:
    def run(part: pd.DataFrame) -> pd.DataFrame:
        known = forest(part["child"].tolist(), part["parent"].tolist(), part["weight"].tolist(), part["low"].tolist(), with_path)
        if with_path:  # a link of an earlier merge stands for several: put its own path in its place
            via = dict(zip(part["child"], part["via"]))
            known["path"] = [[n for step in path for n in via[step]] for path in known["path"]]
        return known

    columns = ["child", "parent", "weight", "low"] + ["via"] * with_path
    return links.select(*columns, F.pmod(F.xxhash64("child"), F.lit(buckets)).alias("bucket")).groupBy("bucket").applyInPandas(run, _FOREST + ", path array<string>" * with_path)


def _jump(links: DataFrame, with_path: bool) -> DataFrame:
    """Every link followed by its parent's link, if there is one: chains get half as long."""
    on = links.select(F.col("child").alias("parent"), F.col("parent").alias("p2"), F.col("weight").alias("w2"), F.col("low").alias("l2"), *[F.col("via").alias("v2")] * with_path)
    return links.join(on, "parent", "left").select(
        "child",
        F.coalesce("p2", "parent").alias("parent"),
        (F.col("weight") + F.coalesce("w2", F.lit(0))).alias("weight"),
        F.least("low", "l2").alias("low"),
        *[F.when(F.col("p2").isNull(), F.col("via")).otherwise(F.concat("via", "v2")).alias("via")] * with_path,
    )


def _wide(links: DataFrame, with_path: bool) -> DataFrame:
    """The forest of links of any number, by joins that double their length until all end at a top.

    While a node that is neither on a cycle nor below one is open, each round closes some; an unchanged count means only cycles are left.
    """
    n, last = -1, None
    while n != 0 and n != last:
        links, last = cut(_jump(links, with_path)), n
        open_links = links.join(links.select(F.col("child").alias("parent")), "parent", "left_semi")
        n = open_links.count()
    tops = links.join(links.select(F.col("child").alias("parent")), "parent", "left_anti")
    done = tops.select("child", F.col("parent").alias("root"), F.col("weight").alias("offset"), F.lit(False).alias("cyclic"), "low", *[F.col("via").alias("path")] * with_path)
    if n == 0:
        return done
    open_links = open_links.select("child", "parent", "weight", "low")  # cyclic nodes have no path
    for _ in range(math.ceil(math.log2(n + 1))):  # until a link goes round any cycle
        open_links = cut(_jump(open_links, False))
    low = open_links.select(F.col("child").alias("parent"), F.col("low").alias("smallest"))
    none = [F.array().cast("array<string>").alias("path")] * with_path
    return done.unionByName(open_links.join(low, "parent").select("child", F.col("smallest").alias("root"), F.lit(-1).cast("bigint").alias("offset"), F.lit(True).alias("cyclic"), F.lit(None).cast("string").alias("low"), *none))


def _merged(links: DataFrame, with_path: bool, bucket: int) -> DataFrame:
    """The forest of all links, (child, root, offset, cyclic, low[, path]), by merging bucket-local forests."""
    n = links.count()
    if n <= bucket:
        return _local(links, 1, with_path)
    local = cut(_local(links, math.ceil(n / bucket), with_path))
    tops = local.where(~F.col("cyclic")).select(F.col("root").alias("child")).distinct()
    at_top = cut(local.join(tops, "child", "left_semi"))
    closed = at_top.where("cyclic")
    inner = at_top.where(~F.col("cyclic")).select("child", F.col("root").alias("parent"), F.col("offset").alias("weight"), "low", *[F.col("path").alias("via")] * with_path)
    merged = _merged(inner, with_path, bucket) if inner.count() <= max(bucket, n // 2) else _wide(inner, with_path)
    return _attach(local, cut(_attach(merged, closed, with_path).unionByName(closed)), with_path)


def _through(joined: DataFrame, with_path: bool) -> DataFrame:
    """t continued by s where s is there; a cyclic s makes t cyclic."""
    bad = F.coalesce(F.col("s.cyclic"), F.lit(False))
    return joined.select(
        F.col("t.child").alias("child"),
        F.coalesce(F.col("s.root"), F.col("t.root")).alias("root"),
        F.when(bad, F.lit(-1)).otherwise(F.col("t.offset") + F.coalesce(F.col("s.offset"), F.lit(0))).cast("bigint").alias("offset"),
        bad.alias("cyclic"),
        F.when(~bad, F.least("t.low", "s.low")).alias("low"),
        *[F.when(bad, F.array().cast("array<string>")).when(F.col("s.path").isNull(), F.col("t.path")).otherwise(F.concat("t.path", "s.path")).alias("path")] * with_path,
    )


def _attach(rows: DataFrame, tops: DataFrame, with_path: bool) -> DataFrame:
    joined = rows.where(~F.col("cyclic")).alias("t").join(tops.alias("s").hint("merge"), F.col("t.root") == F.col("s.child"), "left")
    return rows.where("cyclic").unionByName(_through(joined, with_path))


def hierarchy(relationships: DataFrame, with_path: bool = False, bucket: int = BUCKET, kind: str = "contains") -> DataFrame:
    """(node_id, root_id, depth[, path]) for every id at either end of a link of this kind.

    depth counts the links from the root (0 for a root); on a cycle or below one it is -1 and root_id is the cycle's smallest id. A node that
    links to itself is a cycle. path leads from the root to the node and is null where depth is -1. An empty table gives no rows.
    """
    links = cut(contains_links(relationships, kind).select("child", "parent", F.lit(1).cast("bigint").alias("weight"), F.col("child").alias("low")))
    below = _merged(links.withColumn("via", F.array("child")) if with_path else links, with_path, bucket)
    tops = links.select(F.col("parent").alias("child")).distinct().join(links, "child", "left_anti")
    path = [F.when(~F.col("cyclic"), F.concat(F.array("root"), F.reverse("path"))).alias("path")] * with_path
    return below.select(F.col("child").alias("node_id"), F.col("root").alias("root_id"), F.col("offset").cast("int").alias("depth"), *path).unionByName(
        tops.select(F.col("child").alias("node_id"), F.col("child").alias("root_id"), F.lit(0).alias("depth"), *[F.array("child").alias("path")] * with_path)
    )


def closure(relationships: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(ancestor_id, node_id, distance): every node under each of its proper ancestors; cyclic nodes have no rows."""
    nodes = hierarchy(relationships, True, bucket).where("depth > 0")
    return nodes.select("node_id", "depth", F.posexplode(F.slice("path", 1, F.col("depth"))).alias("at", "ancestor_id")).select("ancestor_id", "node_id", (F.col("depth") - F.col("at")).alias("distance"))


def descendants(relationships: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(node_id, n_descendants, height) of every node with descendants; cyclic nodes have no rows."""
    return closure(relationships, bucket).groupBy(F.col("ancestor_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n_descendants"), F.max("distance").alias("height"))
