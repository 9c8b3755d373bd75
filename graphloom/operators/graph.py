"""Graph traversals: bounded neighbourhoods, impact traces, states, induced worlds.

Objects have (id, ...), relationships (id, kind, from, to[, status]). A hop is one join of a frontier with the relationships; what is seen is written to
the checkpoint folder each hop, and the number of hops is bounded by the caller. Any number of roots can be traced at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from graphloom.session import cut


def not_pending(relationships: DataFrame) -> Column:
    """False for relationships whose status is a text other than confirmed."""
    return (F.coalesce(F.col("status"), F.lit("confirmed")) == "confirmed") if "status" in relationships.columns else F.lit(True)


def neighbourhood(objects: DataFrame, relationships: DataFrame, root: str, depth: int) -> tuple[DataFrame, DataFrame]:
    """(nodes (id, hop), edges (id, from, to)): what is within depth hops of root, without direction.

    Pending relationships are not followed. An edge at an expanded node is kept even where its other end is no object. A missing root gives nothing.
    """
    rels = relationships.where(not_pending(relationships)).select("id", "from", "to")
    seen = cut(objects.where(F.col("id") == root).select("id").distinct().withColumn("hop", F.lit(0)))
    edges = rels.limit(0)
    frontier = seen
    for hop in range(1, depth + 1):
        at = frontier.select(F.col("id").alias("at"))
        out = rels.join(at, F.col("from") == F.col("at"), "left_semi")
        into = rels.join(at, F.col("to") == F.col("at"), "left_semi")
        touched = cut(out.unionByName(into).distinct())
        edges = edges.unionByName(touched)
        ends = touched.select(F.col("from").alias("id")).unionByName(touched.select(F.col("to").alias("id"))).distinct()
        frontier = cut(ends.join(seen, "id", "left_anti").join(objects.select("id").distinct(), "id", "left_semi").withColumn("hop", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen, edges.distinct()


def trace(objects: DataFrame, relationships: DataFrame, root: str | DataFrame, direction: str = "dependents", kinds: list[str] | None = None, max_hops: int = 5) -> DataFrame:
    """(root_id, node_id, hop, edge_id): nodes reached along edges, each by the edge that reached it first, of those the one with the smallest id.

    dependents follows edges from their target to their source, dependencies the other way. Pending edges are not followed; roots are left out; a
    node that is no object counts as reached, but nothing is reached through it.
    """
    spark = objects.sparkSession
    near, far = ("to", "from") if direction == "dependents" else ("from", "to")
    rels = relationships.where(not_pending(relationships))
    if kinds is not None:
        rels = rels.where(F.lower("kind").isin([k.lower() for k in kinds]))
    steps = rels.select(F.col(near).alias("at"), F.col(far).alias("node_id"), F.col("id").alias("edge_id"))
    roots = spark.createDataFrame([(root,)], "root_id string") if isinstance(root, str) else root.select(F.col(root.columns[0]).alias("root_id")).distinct()
    there = objects.select(F.col("id").alias("node_id")).distinct()
    seen = cut(roots.select("root_id", F.col("root_id").alias("node_id"), F.lit(0).alias("hop"), F.lit(None).cast("string").alias("edge_id")))
    frontier = seen
    for hop in range(1, max_hops + 1):
        nxt = frontier.select("root_id", F.col("node_id").alias("at")).join(steps, "at").groupBy("root_id", "node_id").agg(F.min("edge_id").alias("edge_id"))
        nxt = cut(nxt.join(seen, ["root_id", "node_id"], "left_anti").withColumn("hop", F.lit(hop)).select("root_id", "node_id", "hop", "edge_id"))
        if nxt.isEmpty():
            break
        seen = seen.unionByName(nxt)
        frontier = nxt.join(there, "node_id", "left_semi")
    return seen.where("hop > 0").join(there, "node_id", "left_semi").select("root_id", "node_id", "hop", "edge_id")


def touching(relationships: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, relationship columns): relationships at either end of each node (id); a self-loop once."""
    ids = nodes.select(F.col("id").alias("node_id")).distinct()
    a = relationships.join(ids, F.col("from") == F.col("node_id"))
    b = relationships.where(~F.col("from").eqNullSafe(F.col("to"))).join(ids, F.col("to") == F.col("node_id"))
    return a.unionByName(b)


def dependents(objects: DataFrame, relationships: DataFrame) -> DataFrame:
    """(node_id, n_incoming, n_outgoing) of every object; a self-loop counts as incoming."""
    inward = relationships.groupBy(F.col("to").alias("node_id")).agg(F.count(F.lit(1)).alias("i"))
    outward = relationships.where(~F.col("from").eqNullSafe(F.col("to"))).groupBy(F.col("from").alias("node_id")).agg(F.count(F.lit(1)).alias("o"))
    ids = objects.select(F.col("id").alias("node_id")).distinct()
    return ids.join(inward, "node_id", "left").join(outward, "node_id", "left").select("node_id", F.coalesce("i", F.lit(0)).alias("n_incoming"), F.coalesce("o", F.lit(0)).alias("n_outgoing"))


def dependents_named(objects: DataFrame, relationships: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, direction, kind, other_id, other_name) of nodes (id): who points at them (incoming, a self-loop too) and whom they point at, with names."""
    names = objects.select(F.col("id").alias("other_id"), F.col("name").alias("other_name"))
    ids = nodes.select(F.col("id").alias("node_id")).distinct()
    inward = relationships.join(ids, F.col("to") == F.col("node_id")).select("node_id", F.lit("incoming").alias("direction"), "kind", F.col("from").alias("other_id"))
    outward = relationships.where(~F.col("from").eqNullSafe(F.col("to"))).join(ids, F.col("from") == F.col("node_id")).select("node_id", F.lit("outgoing").alias("direction"), "kind", F.col("to").alias("other_id"))
    return inward.unionByName(outward).join(names, "other_id", "left").select("node_id", "direction", "kind", "other_id", "other_name")


def chain(objects: DataFrame, relationships: DataFrame, roots: DataFrame, most: int = 50) -> DataFrame:
    """(root_id, node_id, hop, edge_id): everything upstream of roots (id) along FeedsInto edges, at most so many hops."""
    return trace(objects, relationships, roots, "dependents", ["FeedsInto"], most)


def world(objects: DataFrame, relationships: DataFrame, events: DataFrame, scope: DataFrame, at: str | None = None) -> dict[str, DataFrame]:
    """The subgraph induced by scope (id): its objects, its events up to at, and the relationships with both ends in it that are not pending."""
    ids = scope.select("id").distinct()
    end = lambda c: ids.select(F.col("id").alias(c))
    inside = relationships.where(not_pending(relationships)).join(end("from"), "from", "left_semi").join(end("to"), "to", "left_semi").dropDuplicates(["id"])
    seen = events if at is None else events.where(F.col("occurred_at") <= F.lit(at).cast(events.schema["occurred_at"].dataType))
    return {"objects": objects.join(ids, "id", "left_semi"), "relationships": inside, "events": seen.join(ids, "id", "left_semi")}


def observed_scope(relationships: DataFrame, agents: DataFrame) -> DataFrame:
    """(agent_id, id): each agent (id) and the targets of its Knows edges that are not pending."""
    me = agents.select(F.col("id").alias("agent_id")).distinct()
    knows = relationships.where((F.lower("kind") == "knows") & not_pending(relationships)).join(me, F.col("from") == F.col("agent_id")).select("agent_id", F.col("to").alias("id"))
    return me.select("agent_id", F.col("agent_id").alias("id")).unionByName(knows).distinct()


def state(objects: DataFrame, relationships: DataFrame, evidence: DataFrame, nodes: DataFrame) -> dict[str, DataFrame]:
    """Objects of nodes (id), all relationships touching them (pending too), and the evidence of the objects."""
    mine = objects.join(nodes.select("id").distinct(), "id", "left_semi")
    named = mine.select(F.col("id").alias("object_id"), F.explode("evidence").alias("id")).distinct()
    return {"objects": mine, "relationships": touching(relationships, nodes), "evidence": named.join(evidence, "id")}
