"""Rounds of agents: decisions, validation, order, resources, visibility, trust, forum and replay, as set operations on one round at a time."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, functions as F

from graphloom.operators import graph, ledger
from graphloom.operators.ranking import numbered
from graphloom.session import cut

# What actions cost, what channels hold, and what trust gains.
ENERGY, TRUST_STEP, TRUST_MOST, ALLIANCE_TRUST = 0.1, 0.2, 1.0, 0.4
SURE, IDLE = 0.8, 0.5


def decide(goals: DataFrame, observed: DataFrame) -> DataFrame:
    """(agent_id, action, target, confidence): the first goal (agent_id, position, goal) 'support:x' or 'oppose:x' that names an observed object (agent_id, name), else DoNothing."""
    g = goals.select("agent_id", "position", F.split("goal", ":", 2)[0].alias("verb"), F.trim(F.split("goal", ":", 2)[1]).alias("name")).where("verb in ('support', 'oppose')")
    hit = g.join(observed, ["agent_id", "name"]).groupBy("agent_id").agg(F.min(F.struct("position", "verb", "name")).alias("v"))
    return goals.select("agent_id").distinct().join(hit, "agent_id", "left").select(
        "agent_id", F.when(F.col("v").isNull(), "DoNothing").otherwise(F.initcap("v.verb")).alias("action"), F.col("v.name").alias("target"), F.when(F.col("v").isNull(), IDLE).otherwise(SURE).alias("confidence")
    )


def validate(actions: DataFrame, observed: DataFrame, trust: DataFrame) -> DataFrame:
    """actions (agent_id, action, target) with valid: a target must be observed (agent_id, target); an alliance needs trust (agent_id, target, value) above 0.4."""
    seen = observed.select("agent_id", "target", F.lit(True).alias("_seen")).distinct()
    t = trust.groupBy("agent_id", "target").agg(F.max("value").alias("_t"))
    ok = (F.col("action") == "DoNothing") | (F.col("target").isNotNull() & F.coalesce("_seen", F.lit(False)) & ((F.col("action") != "FormAlliance") | (F.coalesce("_t", F.lit(0.0)) > ALLIANCE_TRUST)))
    return actions.join(seen, ["agent_id", "target"], "left").join(t, ["agent_id", "target"], "left").withColumn("valid", ok).drop("_seen", "_t")


def priority(seed: int, round_: int) -> list[Column]:
    """More confident first; ties in an order drawn from seed and round."""
    return [F.desc("confidence"), F.md5(F.concat(F.lit(f"{seed + round_}:"), F.col("agent_id").cast("string"))), F.col("agent_id")]


def race(posts: DataFrame, capacity: DataFrame, seed: int = 0, round_: int = 0) -> DataFrame:
    """posts (agent_id, channel_id, confidence, energy) with outcome: tired where energy is short, full where the channel (channel_id, capacity) has no room, else done.

    Each action costs the same, so a place in the order decides. Energy is paid before the channel is asked: who finds it full has paid. A channel with
    any number of posts is ordered by ranges.
    """
    paid = posts.withColumn("tired", F.col("energy") < ENERGY)
    placed = numbered(paid, ["channel_id", "tired"], priority(seed, round_), "place").join(capacity, "channel_id", "left")
    outcome = F.when(F.col("tired"), "tired").when(F.col("capacity").isNotNull() & (F.col("place") > F.col("capacity")), "full").otherwise("done")
    return placed.select("agent_id", "channel_id", outcome.alias("outcome"), F.round(F.when(F.col("tired"), F.col("energy")).otherwise(F.col("energy") - ENERGY), 6).alias("energy_left"))


EVERYBODY = "*"
#: Agents that meet public events in one row.
AGENT_BLOCK = 1000


def observers(actions: DataFrame, agents: DataFrame | None = None) -> DataFrame:
    """(event_id, observer_id) of actions (event_id, agent_id, target, visibility): self reaches the actor, private the target too, public everybody.

    Everybody is one row, of the class '*', so that events and agents never multiply; where agents (agent_id) are asked for, public events have a row for
    each of these instead.
    """
    seen = F.when(F.col("visibility") == "public", F.array(F.lit(EVERYBODY))).otherwise(F.array_compact(F.array("agent_id", F.when(F.col("visibility") == "private", F.col("target")))))
    fan_out = actions.select("event_id", F.explode(seen).alias("observer_id")).distinct()
    if agents is None:
        return fan_out
    return fan_out.where(F.col("observer_id") != EVERYBODY).unionByName(_public(fan_out, agents).select("event_id", F.col("agent_id").alias("observer_id"))).distinct()


def observed_by(fan_out: DataFrame, agents: DataFrame) -> DataFrame:
    """(agent_id, event_id) that agents (agent_id), a set that was asked for, see of observers: their own and, each, the public ones."""
    own = fan_out.where(F.col("observer_id") != EVERYBODY).join(agents.select("agent_id").distinct(), F.col("observer_id") == F.col("agent_id")).select("agent_id", "event_id")
    return own.unionByName(_public(fan_out, agents)).distinct()


def _public(fan_out: DataFrame, agents: DataFrame) -> DataFrame:
    """(agent_id, event_id) of the public events and the agents asked for, in blocks; events of one block are salted, so that no task has them all."""
    asked = agents.select("agent_id").distinct()
    blocks = max(1, -(-asked.count() // AGENT_BLOCK))
    salts = fan_out.sparkSession.sparkContext.defaultParallelism
    packed = asked.groupBy(F.pmod(F.xxhash64("agent_id"), F.lit(blocks)).alias("block")).agg(F.collect_list("agent_id").alias("ids")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    public = fan_out.where(F.col("observer_id") == EVERYBODY).select("event_id", F.pmod(F.xxhash64("event_id"), F.lit(salts)).cast("int").alias("salt"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"))
    return public.join(packed, ["block", "salt"]).select(F.explode("ids").alias("agent_id"), "event_id")


def bump_trust(trust: DataFrame, gained: DataFrame) -> DataFrame:
    """trust (agent_id, target, value) after one step for each pair of gained, at most 1; pairs without a value begin at 0."""
    g = gained.select("agent_id", "target", F.lit(TRUST_STEP).alias("_g")).distinct()
    return trust.join(g, ["agent_id", "target"], "full").select("agent_id", "target", F.round(F.least(F.coalesce("value", F.lit(0.0)) + F.coalesce("_g", F.lit(0.0)), F.lit(TRUST_MOST)), 6).alias("value"))


def add_once(edges: DataFrame, more: DataFrame, key: list[str]) -> DataFrame:
    """edges with those of more that are not there yet, once each: likes, follows and shares."""
    return edges.unionByName(more.dropDuplicates(key).join(edges.select(*key), key, "left_anti"))


def channel_messages(messages: DataFrame, channel: str | None = None) -> DataFrame:
    """(channel_id, position, message_id): a channel's messages, oldest first, ties by id; of all channels where none is named."""
    rows = messages if channel is None else messages.where(F.col("channel_id") == channel)
    return numbered(rows.select("channel_id", "sent_at", "message_id"), ["channel_id"], [F.col("sent_at"), F.col("message_id")]).select("channel_id", "position", "message_id")


def rounds(events: DataFrame) -> DataFrame:
    """(round, n_events, first_at, last_at) of events (payload, occurred_at) whose payload names a round, in order."""
    r = F.get_json_object("payload", "$.round").try_cast("int").alias("round")
    return events.select(r, "occurred_at").where("round is not null").groupBy("round").agg(F.count(F.lit(1)).alias("n_events"), F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at"))


def run_round(agents: DataFrame, goals: DataFrame, observed: DataFrame, trust: DataFrame, channels: DataFrame, seed: int, round_: int) -> dict[str, DataFrame]:
    """One round: everybody decides on one observation, invalid actions fall away, the rest race for their channel, and trust grows with support."""
    decided = decide(goals, observed)
    valid = validate(decided, observed.select("agent_id", F.col("name").alias("target")), trust).where("valid and action <> 'DoNothing'")
    posts = valid.join(agents, "agent_id").select("agent_id", "target", "action", "confidence", "energy", "channel_id")
    outcome = race(posts, channels, seed, round_).join(posts.select("agent_id", "target", "action"), "agent_id")
    gained = outcome.where("outcome = 'done' and action = 'Support'").select("agent_id", "target")
    return {"decisions": decided, "outcomes": outcome, "trust": bump_trust(trust, gained)}


def simulate(agents: DataFrame, goals: DataFrame, observed: DataFrame, trust: DataFrame, channels: DataFrame, rounds_: int, seed: int = 0) -> dict[str, DataFrame]:
    """All rounds one after the other, each on what the round before left: events (round, agent_id, action, target, outcome), agents and trust at the end.

    What a round leaves is written to the checkpoint folder before the next one begins.
    """
    events, energy = None, agents
    for r in range(rounds_):
        done = run_round(energy, goals, observed, trust, channels, seed, r)
        outcome = cut(done["outcomes"])
        trust = cut(done["trust"])
        left = outcome.groupBy("agent_id").agg(F.min("energy_left").alias("_left"))
        energy = cut(energy.join(left, "agent_id", "left").withColumn("energy", F.coalesce("_left", "energy")).select(agents.columns))
        one = outcome.select(F.lit(r).alias("round"), "agent_id", "action", "target", "outcome")
        events = one if events is None else events.unionByName(one)
    return {"events": events, "agents": energy, "trust": trust}


def round_times(events: DataFrame) -> DataFrame:
    """(round, at): the time each round's events share, which is that of the state its agents decided on; the earliest where they differ."""
    return rounds(events).select("round", F.col("first_at").alias("at"))


def replay(events: DataFrame, log: DataFrame, round_: int, order: list[str] = ("created_at", "sig"), time: str = "created_at") -> DataFrame:
    """The log's versions (id, ...) as they were going into a round; an unknown round is a LookupError."""
    at = round_times(events).where(F.col("round") == round_).collect()
    if not at:
        raise LookupError(f"round {round_}")
    return ledger.as_of(log, "id", list(order), time, at[0]["at"])


def inspect_agent(objects: DataFrame, relationships: DataFrame, events: DataFrame, agent: str, at) -> dict[str, DataFrame]:
    """What an agent observed at a time: itself and whom its Knows edges of then name, as a world; objects and relationships are version logs."""
    then = lambda log, order: ledger.as_of(log, "id", order, "created_at", at)
    o, r = then(objects, ["created_at", "sig"]), then(relationships, ["created_at", "from", "to"])
    me = o.sparkSession.createDataFrame([(agent,)], "id string")
    return graph.world(o, r, events, graph.observed_scope(r, me).select("id"), at)


class ScenarioError(ValueError):
    """A scenario with a name given twice or a reference to none."""


def load_scenario(document: dict) -> dict[str, object]:
    """names, objects, relationships, goals, rounds and seed of a scenario read from YAML or JSON.

    All agents and events are named before anything refers to them, so the order in the document does not matter. Ids are drawn from the scenario's
    own id and the name, so that loading twice gives the same.
    """
    import uuid

    names: dict[str, str] = {}

    def register(name: str) -> str:
        if name in names:
            raise ScenarioError(f"{name} is named twice")
        names[name] = str(uuid.uuid5(uuid.NAMESPACE_URL, f"scenario:{document['id']}:{name}"))
        return names[name]

    def resolve(name: str) -> str:
        if name not in names:
            raise ScenarioError(f"{name} is not known")
        return names[name]

    agents, events = document.get("agents") or [], document.get("events") or []
    objects = [(register(a["id"]), a.get("name", a["id"]), "SimulatedAgent") for a in agents]
    logged = [(register(e["id"]), e.get("kind", "Created"), e.get("subjects") or []) for e in events]
    rels = []
    for a in agents:
        for other in a.get("knows") or a.get("knowledge") or []:
            rels.append((names[a["id"]], resolve(other), "Knows", None))
        for r in a.get("relationships") or []:
            rels.append((names[a["id"]], resolve(r["target"]), r.get("kind", "Knows"), r.get("trust")))
    settings = document.get("simulation") or {}
    return {
        "names": names, "objects": objects, "events": [(i, k, resolve(s)) for i, k, ss in logged for s in ss], "relationships": rels,
        "goals": [(names[a["id"]], p, g) for a in agents for p, g in enumerate(a.get("goals") or [])], "rounds": int(settings.get("rounds", 1)),
        "seed": settings["seed"] if settings.get("seed") is not None else random.randrange(1 << 31),
    }
