"""Filling fixed-capacity containers with documents (problem 8).

A grouping genetic algorithm works on blocks of documents. A solution is a list of containers; crossover injects well-filled containers of one
parent into the other, drops the containers that hold a document twice and puts the displaced documents where they fit best.
Each block is evolved on several islands; their elites migrate to the next island and are evolved again with the natives, MIGRATIONS times, and
the best island's solution stands. Containers that are nearly full are final; the documents of the others form the blocks of the next level. A level
that fills little makes the fuller half of each block's containers final, so that every level leaves at most half of the tokens of the one before.

Scale: a block holds about BLOCK documents however large the corpus is and whatever fills; sizes, not texts, are shuffled. What is packed where
depends on ids, sizes and the seed alone, not on partitions.
"""

from __future__ import annotations

import bisect
import math
import random

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from graphloom.llm.encode import token_count
from graphloom.session import cut, spread

CAPACITY = 2048
BLOCK = 2000
ISLANDS = 2
MIGRATIONS = 2
POPULATION = 6
GENERATIONS = 10
#: Containers at least this full are final before the last level.
FULL = 0.998
#: A level that leaves more than this share of its tokens fills little.
STALLED = 0.5
#: A block has tokens for at least so many containers.
LEAST_CONTAINERS = 16


def best_fit(sizes: list[int], items: list[int], bins: list[list[int]], fill: list[int], capacity: int) -> None:
    """Puts each item into the fullest container that has room for it, or a new one."""
    room = sorted((capacity - f, b) for b, f in enumerate(fill) if f < capacity)
    for i in items:
        at = bisect.bisect_left(room, (sizes[i], -1))
        if at < len(room):
            left, b = room.pop(at)
            bins[b].append(i)
            fill[b] += sizes[i]
            left -= sizes[i]
        else:
            b, left = len(bins), capacity - sizes[i]
            bins.append([i])
            fill.append(sizes[i])
        if left:
            bisect.insort(room, (left, b))


def fitness(fill: list[int], capacity: int) -> float:
    """The mean square of how full containers are: few full ones and one nearly empty beat many half-full ones."""
    return sum((f / capacity) ** 2 for f in fill) / len(fill) if fill else 1.0


def cross(a: list[list[int]], b: list[list[int]], sizes: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """a with some of b's well-filled containers injected."""
    full = sorted(b, key=lambda x: -sum(sizes[i] for i in x))
    injected = rng.sample(full[: max(1, len(full) // 2)], max(1, len(full) // 8))
    held = {i for x in injected for i in x}
    kept, displaced = [], []
    for x in a:
        if held.isdisjoint(x):
            kept.append(x)
        else:
            displaced += [i for i in x if i not in held]
    # the emptiest container dissolves as well, as a mutation
    if kept and rng.random() < 0.5:
        worst = min(range(len(kept)), key=lambda k: sum(sizes[i] for i in kept[k]))
        displaced += kept.pop(worst)
    bins = [list(x) for x in injected] + [list(x) for x in kept]
    displaced.sort(key=lambda i: -sizes[i])
    best_fit(sizes, displaced, bins, [sum(sizes[i] for i in x) for x in bins], capacity)
    return bins


def evolve(sizes: list[int], capacity: int, rng: random.Random, elites: list[list[list[int]]] = (), population: int = POPULATION, generations: int = GENERATIONS) -> list[list[int]]:
    """The best solution found; the population begins with noisy best-fit solutions, and stops early where nothing could be better.

    Nothing could be better than the fewest containers there can be, all but one of them nearly full.
    """
    least = math.ceil(sum(sizes) / capacity)

    def judged(s: list[list[int]]) -> tuple:
        fill = [sum(sizes[i] for i in x) for x in s]
        return len(s), -fitness(fill, capacity), sum(f < FULL * capacity for f in fill), s

    rank = lambda j: j[:2]
    ideal = lambda j: j[0] <= least and j[2] <= 1
    pool = [judged([list(b) for b in e]) for e in elites]
    order = list(range(len(sizes)))
    while len(pool) < population and not any(map(ideal, pool)):
        noise = 0.0 if len(pool) == len(elites) else 0.3
        keyed = {i: sizes[i] * (1 + noise * (rng.random() - 0.5)) for i in order}
        bins: list[list[int]] = []
        best_fit(sizes, sorted(order, key=lambda i: (-keyed[i], i)), bins, [], capacity)
        pool.append(judged(bins))
    pool.sort(key=rank)
    for _ in range(generations):
        if ideal(pool[0]) or len(pool) < 2:
            break
        a, b = rng.sample(pool[: max(2, population // 2)], 2)
        children = [judged(cross(x[3], y[3], sizes, capacity, rng)) for x, y in ((a, b), (b, a))]
        pool = sorted([*pool, *children], key=rank)[:population]
    return pool[0][3]


_SOLVED = "block int, island int, piece_id bigint, doc_id bigint, piece int, start bigint, n_tokens int, bin int"


def _evolved(capacity: int, seed: int):
    """One island of one block: evolves from the solutions in the bin columns of its natives and migrants, if there are any."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("piece_id", kind="stable")
        own = pdf[pdf["origin"] == 0].reset_index(drop=True)
        sizes = own["n_tokens"].tolist()
        block, island = int(own["block"].iloc[0]), int(own["island"].iloc[0])
        elites = []
        for _, part in pdf.groupby("origin"):
            if (part["bin"] >= 0).all():
                bins: dict[int, list[int]] = {}
                for i, b in enumerate(part["bin"].tolist()):
                    bins.setdefault(b, []).append(i)
                elites.append(list(bins.values()))
        best = evolve(sizes, capacity, random.Random(f"{seed}:{block}:{island}:{len(elites)}"), elites)
        number = {i: b for b, x in enumerate(best) for i in x}
        own["bin"] = [number[i] for i in range(len(sizes))]
        return own[["block", "island", "piece_id", "doc_id", "piece", "start", "n_tokens", "bin"]]

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS, seed: int = 7, migrations: int = MIGRATIONS) -> DataFrame:
    """(container_id, piece_id, doc_id, piece, start, n_tokens) of pieces (piece_id, doc_id, piece, start, n_tokens), each of 1 to capacity tokens."""
    columns = ["piece_id", "doc_id", "piece", "start", "n_tokens"]
    size = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t")).collect()[0]
    rest, done, level = cut(pieces.select(*columns)), None, 0
    n, tokens = size(rest)
    while n or done is None:
        blocks = max(1, min(math.ceil(n / block), tokens // (LEAST_CONTAINERS * capacity)))
        placed = rest.withColumn("block", F.pmod(F.xxhash64("piece_id", F.lit(level)), F.lit(blocks)).cast("int"))
        on = placed.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).withColumn("bin", F.lit(-1)).withColumn("origin", F.lit(0))
        first = cut(on.groupBy("block", "island").applyInPandas(_evolved(capacity, seed), _SOLVED))
        for turn in range(migrations):
            natives = first.withColumn("origin", F.lit(0))
            migrants = first.withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands))).withColumn("origin", F.lit(1))
            first = cut(natives.unionByName(migrants).groupBy("block", "island").applyInPandas(_evolved(capacity, seed + turn + 1), _SOLVED))
        fill = first.groupBy("block", "island", "bin").agg(F.sum("n_tokens").alias("filled"))
        judged = fill.groupBy("block", "island").agg(F.count(F.lit(1)).alias("bins"), F.sum((F.col("filled") / capacity) ** 2).alias("squares"))
        winner = judged.groupBy("block").agg(F.max_by("island", F.struct(-F.col("bins"), "squares", -F.col("island"))).alias("island"))
        last = blocks == 1
        best = cut(first.join(winner, ["block", "island"]).join(fill, ["block", "island", "bin"]))
        full = F.lit(True) if last else F.col("filled") >= FULL * capacity
        if not last and size(best.where(~full))["t"] > STALLED * tokens:
            middle = fill.join(winner, ["block", "island"]).groupBy("block").agg(F.percentile("filled", 0.5).alias("middle"))
            best = best.join(middle, "block")
            full = F.col("filled") >= F.col("middle")
        final = best.where(full)
        number = F.lit(level).cast("bigint") * (1 << 52) + F.col("block").cast("bigint") * (1 << 20) + F.col("bin")
        final = final.select(number.alias("container_id"), *columns)
        done = final if done is None else done.unionByName(final)
        if last:
            break
        rest = cut(best.where(~full).select(*columns))
        (n, tokens), level = size(rest), level + 1
    return done


def pieces_of(documents: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """(piece_id, doc_id, piece, start, n_tokens): a document of at most capacity tokens is one piece, a longer one is cut into full pieces and a rest.

    piece_id is a hash of the piece and of which of several equal rows it is, so that it does not depend on partitions.
    """
    n = spread(documents.select("doc_id", "text")).select("doc_id", token_count(F.col("text"), path).alias("n"))
    starts = F.when(F.col("n") <= 0, F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), (F.col("n") - 1).cast("bigint"), F.lit(capacity).cast("bigint")))
    same = n.groupBy("doc_id", "n").agg(F.count(F.lit(1)).alias("k")).select("doc_id", "n", F.explode(F.sequence(F.lit(1), F.col("k").cast("int"))).alias("copy"))
    rows = same.select("doc_id", "n", "copy", F.posexplode(starts).alias("piece", "start"))
    return rows.select(F.xxhash64("doc_id", "n", "copy", "piece").alias("piece_id"), "doc_id", "piece", "start", F.least(F.col("n") - F.col("start"), F.lit(capacity)).cast("int").alias("n_tokens"))


def containers(documents: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS, path: str | None = None) -> DataFrame:
    """(container_id, doc_id, piece, start, n_tokens): every document, in pieces only if it alone exceeds capacity.

    No container holds more than capacity tokens. Null and empty texts take no space and come with container -1. A full piece of a long document has a
    container of its own. Repeated rows are packed each; an empty table gives no rows; extra columns are ignored.
    """
    pieces = cut(pieces_of(documents, capacity, path))
    whole = pieces.where(F.col("n_tokens") == capacity)
    none = pieces.where("n_tokens = 0").select(F.lit(-1).cast("bigint").alias("container_id"), "doc_id", "piece", "start", "n_tokens")
    # containers of packed pieces are below 2^60, those of full pieces above
    alone = whole.select((F.lit(1 << 60) + F.xxhash64("piece_id", F.lit("alone")).bitwiseAND(F.lit((1 << 60) - 1))).alias("container_id"), "doc_id", "piece", "start", "n_tokens")
    packed = pack(pieces.where((F.col("n_tokens") > 0) & (F.col("n_tokens") < capacity)), capacity, block, islands)
    return packed.select("container_id", "doc_id", "piece", "start", "n_tokens").unionByName(alone).unionByName(none)


def usage(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(n_containers, n_tokens, fewest, unused, fullest): one row; fewest is the least number of containers there could be."""
    per = packed.where("container_id >= 0").groupBy("container_id").agg(F.sum("n_tokens").alias("filled"))
    total = per.agg(F.count(F.lit(1)).alias("n_containers"), F.coalesce(F.sum("filled"), F.lit(0)).alias("n_tokens"), F.coalesce(F.max("filled"), F.lit(0)).alias("fullest"))
    return total.select("n_containers", "n_tokens", F.ceil(F.col("n_tokens") / capacity).alias("fewest"), (F.col("n_containers") * capacity - F.col("n_tokens")).alias("unused"), "fullest")
