"""Identity resolution: blocked similarity, groups, conflicts, cross-system candidates, review decisions."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from graphloom.functions.text import comparable_name, cross_system_name, normalized_name, type_family
from graphloom.session import cut

# Thresholds, weights and what identity leaves alone.
THRESHOLD, CONCEPT_THRESHOLD = 0.90, 0.95
WEIGHTS = {"column_overlap": 0.4, "name_pattern": 0.4, "type_compat": 0.2}
CROSS_SYSTEM_LEAST = 0.3
EXCLUDED = ("Section", "TransformNode", "RustSymbol", "RustModule", "PythonSymbol", "PythonModule", "Crate", "Claim", "ArchitectureGap")
FREE_TEXT_MOST, FREE_TEXT_WORD = 20, 0.90
#: Objects of a block, which meet those of another in one row, scored so many at a time; more where there would be over PAIR_BLOCKS blocks, up to PAIR_MOST.
PAIR_BLOCK, PAIR_BLOCKS, PAIR_MOST = 1000, 16, 10_000
#: Names of a block that meet those of another tile in one row.
NAME_TILE = 500
#: Links that one task resolves to groups.
BUCKET = 200_000


def jaro(a: str, b: str) -> float:
    """Jaro similarity; half transpositions count."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2, 1) - 1
    used, pairs = set(), []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j not in used and b[j] == c), None)
        if j is not None:
            used.add(j)
            pairs.append(c)
    if not pairs:
        return 0.0
    m = len(pairs)
    half = sum(x != b[j] for x, j in zip(pairs, sorted(used))) / 2
    return (m / len(a) + m / len(b) + (m - half) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """Jaro with a tenth of the rest for each of up to four common first letters, whatever the similarity."""
    s, n = jaro(a, b), 0
    while n < min(4, len(a), len(b)) and a[n] == b[n]:
        n += 1
    return s + 0.1 * n * (1 - s)


#: Letters of a word that fit the bits of one number.
LONGEST = 64


def _coded(words: list[str]) -> np.ndarray:
    """Code points of words, a row each, padded with zeros."""
    wide = max(1, *map(len, words))
    return np.frombuffer("".join(w.ljust(wide, "\0") for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), wide)


def jaro_winkler_of(xs: list[str], ys: list[str], ia: np.ndarray, ib: np.ndarray, most: int = 4096, table: int = 4_000_000) -> np.ndarray:
    """jaro_winkler of the pairs xs[ia], ys[ib] at once: places of a letter are bits, so a letter of the first word is one step. Pairs with a longer word than LONGEST one by one."""
    out = np.zeros(len(ia))
    long_x, long_y = (np.array([len(w) > LONGEST for w in words], bool) for words in (xs, ys))
    far = long_x[ia] | long_y[ib]
    for k in np.flatnonzero(far):
        out[k] = jaro_winkler(xs[ia[k]], ys[ib[k]])
    todo = np.flatnonzero(~far)
    if not len(todo):
        return out
    xs, ys = (["" if o else w for w, o in zip(words, over)] for words, over in ((xs, long_x), (ys, long_y)))
    lx, ly = (np.array([len(w) for w in words], np.int64) for words in (xs, ys))
    x, y = _coded(xs), _coded(ys)
    alphabet = np.union1d(x, y)
    x, y = np.searchsorted(alphabet, x), np.searchsorted(alphabet, y)
    todo = todo[np.argsort(ib[todo], kind="stable")]
    step = max(1, table // len(alphabet))
    for lo in range(0, len(ys), step):  # with many letters, fewer words at once
        first, last = np.searchsorted(ib[todo], (lo, lo + step))
        if first == last:
            continue
        y_, ly_ = y[lo : lo + step], ly[lo : lo + step]
        places = np.zeros((len(y_), len(alphabet)), np.uint64)
        for j in range(y.shape[1]):
            at = np.flatnonzero(ly_ > j)
            places[at, y_[at, j]] |= np.uint64(1 << j)
        for at in range(first, last, most):
            k = todo[at : min(at + most, last)]
            out[k] = _met(x, lx, y_, ly_, places.ravel(), len(alphabet), ia[k], ib[k] - lo)
    return out


def _met(x: np.ndarray, lx: np.ndarray, y: np.ndarray, ly: np.ndarray, places: np.ndarray, letters: int, ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
    """jaro_winkler of pairs of coded words; places holds the bits of each of letters in each word of y."""
    one, la, lb = np.uint64(1), lx[ia], ly[ib]
    reach = np.maximum(np.maximum(la, lb) // 2, 1) - 1
    window, used, base = (one << (reach + 1).astype(np.uint64)) - one, np.zeros(len(ia), np.uint64), ib * letters
    hits, found = [], []
    for i in range(int(la.max())):
        there = np.where(i < la, places[base + x[ia, i]], np.uint64(0))
        free = there & window & ~used
        low = free & (~free + one)
        used |= low
        hits.append(low != 0)
        found.append(there)
        window = (window << one) | (i < reach).astype(np.uint64)
    m, other = np.bitwise_count(used).astype(np.int64), np.zeros(len(ia), np.int64)
    for hit, there in zip(hits, found):
        low = np.where(hit, used & (~used + one), np.uint64(0))
        other += hit & ((there & low) == 0)
        used ^= low
    jaro_ = np.where(m > 0, (m / np.maximum(la, 1) + m / np.maximum(lb, 1) + (m - other / 2) / np.maximum(m, 1)) / 3, 0.0)
    jaro_[(la == 0) & (lb == 0)] = 1.0
    same, prefix = np.ones(len(ia), bool), np.zeros(len(ia), np.int64)
    for i in range(min(4, x.shape[1], y.shape[1])):
        same &= (x[ia, i] == y[ib, i]) & (i < la) & (i < lb)
        prefix += same
    return jaro_ + 0.1 * prefix * (1 - jaro_)


def jaro_winkler_many(a: list[str], b: list[str]) -> np.ndarray:
    """jaro_winkler of many pairs at once."""
    xs, ys = {}, {}
    ia, ib = (np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words)) for words, codes in ((a, xs), (b, ys)))
    return jaro_winkler_of(list(xs), list(ys), ia, ib)


@F.pandas_udf(T.DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    there = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    out[there] = jaro_winkler_many(a[there].tolist(), b[there].tolist())
    return pd.Series(out).astype(object).where(~np.isnan(out), None).astype("float64")


def jaccard(a: Column, b: Column) -> Column:
    """Common elements of two arrays over all; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def structural(a: str, b: str) -> Column:
    """How alike two objects of one kind are beside their names: Jaccard of their columns if both have some, else of their row cells if both have some, else 1."""
    of = lambda c: (F.col(f"{a}.{c}"), F.col(f"{b}.{c}"))
    both = lambda c: of(c)[0].isNotNull() & of(c)[1].isNotNull()
    return F.when(both("columns"), jaccard(*of("columns"))).when(both("cells"), jaccard(*of("cells"))).otherwise(F.lit(1.0))


def _near(batches, plain: bool):
    """Record batches (kind, block, ka, kb, jw, fa, fb) of the pairs of names of rows (kind, block, least, a, b), the shorter first, that may reach least: those with an id (first) on both sides, or the others."""
    for batch in batches:
        for row in range(batch.num_rows):
            kind, block, least, a, b = (batch.column(c)[row].as_py() for c in range(5))
            (ka, fa), (kb, fb) = (([o["key"] for o in side], [o["first"] for o in side]) for side in (a, b))
            rank = {w: i for i, w in enumerate(sorted({*ka, *kb}, key=lambda w: (len(w), w)))}
            (ra, la, sa), (rb, lb, sb) = ((np.array([rank[w] for w in k]), np.array([len(w) for w in k]), np.array([x is not None for x in f])) for k, f in ((ka, fa), (kb, fb)))
            meet = (ra[:, None] < rb) & (2 * lb <= 7 * la[:, None] + 1) & ((sa[:, None] & sb) == plain)
            i, j = np.nonzero(meet)
            jw = jaro_winkler_of(ka, kb, i, j)
            keep = 0.7 * jw + 0.3 >= least - 1e-6
            i, j = pa.array(i[keep]), pa.array(j[keep])
            names = [pa.array(x, pa.string()).take(k) for x, k in ((ka, i), (kb, j), (fa, i), (fb, j))]
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(kind, pa.string()), len(i)), pa.repeat(pa.scalar(block, pa.string()), len(i)), *names[:2], pa.array(jw[keep]), *names[2:]], ["kind", "block", "ka", "kb", "jw", "fa", "fb"])


def blocked_pairs(objects: DataFrame, excluded: list[str] = EXCLUDED, largest: int = 1000, thresholds: dict[str, float] | None = None, tile: int = NAME_TILE) -> DataFrame:
    """(left_id, right_id, left_name, right_name, kind, score) of objects (id, name, kind) of one kind whose normalised names share three first letters, at or above the threshold.

    Objects may have columns and cells, sorted arrays or null, for the structural part of the score. Equal comparable names with equal columns and cells
    are one class: its smallest id links to the others, and only classes are paired, through pairs of names that alone do not rule them out. Blocks of more
    than largest names are split by the length of the name, with neighbours in length met as well, so that no block is paired whole and no pair above the
    threshold is lost; tiles of a block meet tile against tile, in one row each, which is compared on arrays. Kinds whose ids already say all are left out; thresholds has those of single kinds.
    """
    structure = [F.col(c) if c in objects.columns else F.lit(None).cast("array<string>").alias(c) for c in ("columns", "cells")]
    named = objects.where(~F.col("kind").isin(list(excluded)) if excluded else F.lit(True)).select("id", "kind", comparable_name(F.col("name"), F.col("kind")).alias("shown"), normalized_name(F.col("name")).alias("norm"), *structure)
    named = named.where((F.col("norm") != "") & ((F.col("kind") != "Concept") | ((F.size(F.split("norm", " ")) >= 2) & (F.length("norm") >= 8))))
    named = cut(named.select("id", "kind", F.substring("norm", 1, 3).alias("block"), normalized_name(F.col("shown")).alias("key"), "columns", "cells"))
    classes = cut(named.groupBy("kind", "block", "key", "columns", "cells").agg(F.min("id").alias("first")))
    n, c = named.alias("n"), classes.alias("c")
    equal = F.lit(True)
    for x in ("kind", "block", "key", "columns", "cells"):
        equal = equal & F.col(f"n.{x}").eqNullSafe(F.col(f"c.{x}"))
    copies = n.join(c, equal).where("id <> first").select(F.col("first").alias("left_id"), F.col("id").alias("right_id"), F.col("n.key").alias("left_name"), F.col("n.key").alias("right_name"), F.col("n.kind").alias("kind"), F.lit(1.0).alias("score"))
    rich = F.max(F.col("columns").isNotNull() | F.col("cells").isNotNull())
    # a key of one class with neither columns nor cells carries its id, so its pairs need no join to be scored
    keys = cut(classes.groupBy("kind", "block", "key").agg(F.count(F.lit(1)).alias("n"), F.when((F.count(F.lit(1)) == 1) & ~rich, F.min("first")).alias("first")))
    heavy = keys.groupBy("kind", "block").agg((F.count(F.lit(1)) > largest).alias("heavy"))
    # a score of 0.9 needs a Jaro of at least 0.762, which the shorter name can reach with 2/7 of the letters of the longer; so cells reach two steps up
    cell = F.when(F.col("heavy"), F.floor(F.log2(F.greatest(F.length("key"), F.lit(1)))).cast("int")).otherwise(0)
    sized = keys.join(heavy, ["kind", "block"]).withColumn("cell", cell)
    left = sized.withColumn("cell", F.explode(F.when(F.col("heavy"), F.array(*[F.col("cell") + i for i in range(3)])).otherwise(F.array("cell"))))
    least = F.lit(THRESHOLD)
    for k, t in ({"Concept": CONCEPT_THRESHOLD} | (thresholds or {})).items():
        least = F.when(F.col("kind") == k, t).otherwise(least)

    def tiles(df, name):
        many = df.groupBy("kind", "block", "cell").agg(F.ceil(F.count(F.lit(1)) / tile).alias("many"))
        numbered = df.join(many, ["kind", "block", "cell"]).withColumn(f"{name}_tile", F.pmod(F.xxhash64("key"), F.col("many")))
        return numbered.groupBy("kind", "block", "cell", f"{name}_tile").agg(F.collect_list(F.struct("key", "first")).alias(name))

    meetings = tiles(left, "a").join(tiles(sized, "b").hint("merge"), ["kind", "block", "cell"]).withColumn("least", least)
    meetings = cut(meetings.repartition(4 * meetings.sparkSession.sparkContext.defaultParallelism, "kind", "block", "cell", "a_tile", "b_tile").select("kind", "block", "least", "a", "b"))
    passed = lambda plain: meetings.mapInArrow(lambda batches: _near(batches, plain), "kind string, block string, ka string, kb string, jw double, fa string, fb string").where(F.round(0.7 * F.col("jw") + 0.3, 6) >= least)
    alike = passed(False).drop("fa", "fb").unionByName(keys.where("n > 1").select("kind", "block", F.col("key").alias("ka"), F.col("key").alias("kb"), F.lit(1.0).alias("jw")))
    side = lambda k, name: classes.select("kind", "block", F.col("key").alias(k), F.struct("first", "columns", "cells").alias(name))
    met = alike.join(side("ka", "a"), ["kind", "block", "ka"]).join(side("kb", "b"), ["kind", "block", "kb"]).where((F.col("ka") != F.col("kb")) | (F.col("a.first") < F.col("b.first")))
    scored = met.withColumn("score", F.round(0.7 * F.col("jw") + 0.3 * structural("a", "b"), 6)).where(F.col("score") >= least).select("kind", "ka", "kb", F.col("a.first").alias("fa"), F.col("b.first").alias("fb"), "score")
    scored = scored.unionByName(passed(True).select("kind", "ka", "kb", "fa", "fb", F.round(0.7 * F.col("jw") + 0.3, 6).alias("score")))
    one = lambda x, y: F.when(F.col("fa") > F.col("fb"), F.col(y)).otherwise(F.col(x))
    ordered = scored.select(one("fa", "fb").alias("left_id"), one("fb", "fa").alias("right_id"), one("ka", "kb").alias("left_name"), one("kb", "ka").alias("right_name"), "kind", "score")
    return copies.unionByName(ordered)


def _stars(batches, most: int):
    """Record batches (u, v) of each most links (u, v) of batches, or the last ones: every vertex but the smallest of each of their components, with that smallest.

    If links have same and score, so have these: whether all links of the component have it, and its best score.
    """

    def solved(links: pa.Table) -> pa.RecordBatch:
        ends = pa.chunked_array([*links["u"].chunks, *links["v"].chunks]).combine_chunks().dictionary_encode()
        order = pc.sort_indices(ends.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        left, right = rank[ends.indices.to_numpy()].reshape(2, -1)
        label = np.arange(len(order))
        while True:
            before = label.copy()
            low = np.minimum(label[left], label[right])
            for at in (left, right, before[left], before[right]):
                np.minimum.at(label, at, low)
            label = label[label]
            if (label == before).all():
                break
        moved, names = np.flatnonzero(label != np.arange(len(order))), ends.dictionary.take(order)
        out = {"u": names.take(pa.array(moved)), "v": names.take(pa.array(label[moved]))}
        if "same" in links.column_names:
            same, score = np.ones(len(order), bool), np.full(len(order), -np.inf)
            np.logical_and.at(same, label[left], links["same"].to_numpy())
            np.maximum.at(score, label[left], links["score"].to_numpy())
            out |= {"same": pa.array(same[label[moved]]), "score": pa.array(score[label[moved]])}
        return pa.RecordBatch.from_pydict(out)

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= most:
            yield solved(pa.Table.from_batches(held))
            held, rows = [], 0
    if rows:
        yield solved(pa.Table.from_batches(held))


def _smallest(links: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(u, v): every vertex of links (u, v) but the smallest of each component, with that smallest.

    Tasks first keep of their links only what joins their vertices. While more than bucket are left, each vertex takes its smallest neighbour, these pointers
    are followed by doubling, and links between their ends go on; the rest is one task. So rounds do not follow the length of chains.
    """
    reduced = lambda df: cut(df.where("u <> v").mapInArrow(lambda batches: _stars(batches, bucket), "u string, v string").distinct())
    maps, links = [], reduced(links)
    while links.count() > bucket:
        to = cut(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).groupBy("u").agg(F.min("v").alias("v")).where("v < u"))
        while True:
            far = to.select(F.col("u").alias("v"), F.col("v").alias("w"))
            if to.join(far, "v", "left_semi").isEmpty():
                break
            to = cut(to.join(far, "v", "left").select("u", F.coalesce("w", "v").alias("v")))
        maps.append(to)
        for end in ("u", "v"):
            links = links.join(to.select(F.col("u").alias(end), F.col("v").alias("to")), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        links = reduced(links)
    total = cut(links.coalesce(1).mapInArrow(lambda batches: _stars(batches, bucket + 1), "u string, v string"))
    for first in reversed(maps):
        far = total.select(F.col("u").alias("v"), F.col("v").alias("w"))
        total = cut(first.join(far, "v", "left").select("u", F.coalesce("w", "v").alias("v")).unionByName(total))
    return total


def condensed(pairs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(left_id, right_id, same, score): what merge_groups, group_confidence and review_links need of pairs (left_id, right_id, left_name, right_name, score) without nulls, of two different ids each.

    Each bucket of pairs leaves one for each vertex but the smallest of its components, so a number of pairs that is quadratic in the records is never written.
    """
    links = pairs.select(F.col("left_id").alias("u"), F.col("right_id").alias("v"), (F.col("left_name") == F.col("right_name")).alias("same"), "score")
    kept = links.mapInArrow(lambda batches: _stars(batches, bucket), "u string, v string, same boolean, score double")
    return cut(kept.groupBy(F.col("u").alias("left_id"), F.col("v").alias("right_id")).agg(F.min("same").alias("same"), F.max("score").alias("score")))


def merge_groups(pairs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(id, canonical_id, exact): records linked by pairs (left_id, right_id, left_name, right_name), or condensed ones, take the smallest id of their group; exact if all names of the group are equal."""
    same = F.col("same") if "same" in pairs.columns else F.col("left_name") == F.col("right_name")
    links = cut(pairs.select(F.col("left_id").alias("u"), F.col("right_id").alias("v"), same.alias("same")))
    moved = _smallest(links.select("u", "v"), bucket)
    ids = links.select("u").union(links.select("v")).where("u is not null").distinct()
    label = cut(ids.join(moved, "u", "left").select("u", F.coalesce("v", "u").alias("label")))
    exact = links.groupBy("u").agg(F.min("same").alias("same")).join(label, "u").groupBy("label").agg(F.min("same").alias("exact"))
    return label.join(exact, "label").select(F.col("u").alias("id"), F.col("label").alias("canonical_id"), "exact")


def group_confidence(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """(canonical_id, n_members, exact, confidence): each group of merge_groups with the best score of its pairs."""
    best = pairs.join(groups.select(F.col("id").alias("left_id"), "canonical_id"), "left_id").groupBy("canonical_id").agg(F.max("score").alias("confidence"))
    sizes = groups.groupBy("canonical_id").agg(F.count(F.lit(1)).alias("n_members"), F.min("exact").alias("exact"))
    return sizes.join(best, "canonical_id").select("canonical_id", "n_members", "exact", "confidence")


def conflicts(objects: DataFrame) -> DataFrame:
    """(norm_name, n_kinds, kinds): normalised names that objects of several kinds share."""
    n = objects.select(normalized_name(F.col("name")).alias("norm_name"), "kind").where("norm_name <> ''")
    return n.groupBy("norm_name").agg(F.count_distinct("kind").alias("n_kinds"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds")).where("n_kinds > 1")


def type_compatibility(columns: DataFrame) -> DataFrame:
    """(left, right, column_overlap, type_compat) of tables that share a column; columns is (table_name, column_name, data_type).

    Only tables with a common column meet, through it; type_compat is the share of common columns whose type families agree.
    """
    c = columns.select("table_name", F.lower("column_name").alias("column_name"), type_family(F.col("data_type")).alias("family")).dropDuplicates(["table_name", "column_name"])
    size = c.groupBy("table_name").agg(F.count(F.lit(1)).alias("n"))
    a, b = c.alias("a"), c.alias("b")
    common = a.join(b, (F.col("a.column_name") == F.col("b.column_name")) & (F.col("a.table_name") < F.col("b.table_name"))).groupBy(F.col("a.table_name").alias("left"), F.col("b.table_name").alias("right")).agg(F.count(F.lit(1)).alias("k"), F.avg((F.col("a.family") == F.col("b.family")).cast("double")).alias("type_compat"))
    with_sizes = common.join(size.select(F.col("table_name").alias("left"), F.col("n").alias("nl")), "left").join(size.select(F.col("table_name").alias("right"), F.col("n").alias("nr")), "right")
    return with_sizes.select("left", "right", F.round(F.col("k") / (F.col("nl") + F.col("nr") - F.col("k")), 6).alias("column_overlap"), F.round("type_compat", 6).alias("type_compat"))


def combined_signal(column_overlap: Column, name_pattern: Column, type_compat: Column) -> Column:
    """The weighted mean of the signals that are there."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, c in (("column_overlap", column_overlap), ("name_pattern", name_pattern), ("type_compat", type_compat)):
        total = total + F.coalesce(c * WEIGHTS[name], F.lit(0.0))
        weight = weight + F.when(c.isNotNull(), WEIGHTS[name]).otherwise(0.0)
    return F.when(weight > 0, total / weight).otherwise(F.lit(0.0))


def _name_patterns(a: list[str], b: list[str], most: int = 1_000_000) -> np.ndarray:
    """jaro_winkler of every name of a with every name of b."""
    out = np.zeros((len(a), len(b)))
    step = max(1, most // max(1, len(b)))
    for at in range(0, len(a), step):
        part = a[at : at + step]
        out[at : at + step] = jaro_winkler_of(part, b, np.repeat(np.arange(len(part)), len(b)), np.tile(np.arange(len(b)), len(part))).reshape(len(part), len(b))
    return out


def _confident(a: list[dict], b: list[dict], same: bool, most: int = 200_000):
    """Record batches (left, right, confidence) of the pairs of two lists of objects, or of one list with itself, of at least CROSS_SYSTEM_LEAST."""
    ids = sorted({o["id"] for o in a} | {o["id"] for o in b})
    at, text = {x: i for i, x in enumerate(ids)}, pa.array(ids, pa.string())
    codes: dict = {}

    def side(objects):
        named = np.array([codes.setdefault((o["kind"], o["shown"]), len(codes)) for o in objects])
        norms, norm = np.unique([o["norm"] for o in objects], return_inverse=True)
        kinds = [{c["name"]: c["family"] for c in o["columns"] or []} for o in objects]
        return np.array([at[o["id"]] for o in objects]), named, norms.tolist(), norm, kinds

    (pa_, na, ua, xa, ca), (pb, nb, ub, xb, cb) = side(a), side(b)
    names = _name_patterns(ua, ub)
    typed = lambda cs: [{(k, f) for k, f in c.items() if f is not None} for c in cs]
    sides = {"column": ([set(c) for c in ca], [set(c) for c in cb]), "agree": (typed(ca), typed(cb))}
    sides["typed"] = tuple([{k for k, _ in c} for c in cs] for cs in sides["agree"])

    def incidence(name):
        left, right = sides[name]
        known = {k: i for i, k in enumerate(set().union(*left) & set().union(*right))}
        out = []
        for cs in (left, right):
            m = np.zeros((len(cs), max(1, len(known))), np.float32)
            for i, c in enumerate(cs):
                m[i, [known[k] for k in c if k in known]] = 1
            out.append(m)
        return out[0], out[1].T

    inc = {name: incidence(name) for name in sides}
    sa, sb = np.array([len(c) for c in ca]), np.array([len(c) for c in cb])
    step = max(1, most // max(1, len(b)))
    for lo in range(0, len(a), step):
        s = slice(lo, lo + step)
        common, shared, agree = ((inc[name][0][s] @ inc[name][1]).astype(np.float64) for name in ("column", "typed", "agree"))
        both = (sa[s, None] > 0) & (sb[None, :] > 0)
        overlap = common / np.maximum(sa[s, None] + sb[None, :] - common, 1)
        w = WEIGHTS
        total = w["name_pattern"] * names[xa[s]][:, xb] + w["column_overlap"] * np.where(both, overlap, 0) + w["type_compat"] * agree / np.maximum(shared, 1)
        score = np.round(total / (w["name_pattern"] + w["column_overlap"] * both + w["type_compat"] * (shared > 0)), 6)
        keep = (score >= CROSS_SYSTEM_LEAST) & (na[s, None] != nb[None, :])
        keep &= (pa_[s, None] < pb[None, :]) if same else (pa_[s, None] != pb[None, :])
        i, j = np.nonzero(keep)
        x, y = pa_[s][i], pb[j]
        yield pa.RecordBatch.from_arrays([text.take(pa.array(np.minimum(x, y))), text.take(pa.array(np.maximum(x, y))), pa.array(score[keep])], ["left", "right", "confidence"])


def pair_blocks(n: int, block: int = PAIR_BLOCK) -> int:
    """Blocks of n objects. Each object is shuffled once for each block, so blocks grow with n as far as one row can be scored."""
    return max(1, -(-n // min(max(block, -(-n // PAIR_BLOCKS)), max(block, PAIR_MOST))))


def cross_system_pairs(objects: DataFrame, block: int = PAIR_BLOCK) -> DataFrame:
    """(left, right, confidence): all pairs of objects (id, kind, name, columns of (name, data_type)) with combined confidence of at least 0.3, but those of one kind and one name in any case.

    Jaro is at least a third as soon as one letter matches, so hardly a pair can be ruled out unscored: blocks of objects meet block against block, each two
    once and in one row, which is scored on arrays. Names are compared once for each two different names of a meeting.
    """
    lower = F.transform("columns", lambda c: F.struct(F.lower(c["name"]).alias("name"), type_family(c["data_type"]).alias("family")))
    name = F.coalesce("name", F.lit(""))
    o = cut(objects.select("id", "kind", F.lower(name).alias("shown"), cross_system_name(name).alias("norm"), lower.alias("columns")))
    blocks = pair_blocks(o.count(), block)
    packed = cut(o.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("id", "kind", "shown", "norm", "columns")).alias("objects")))
    met = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    left = met.where("block <= other").select(F.col("block").alias("i"), F.col("other").alias("j"), F.col("objects").alias("a"))
    right = met.where("block >= other").select(F.col("other").alias("i"), F.col("block").alias("j"), F.col("objects").alias("b"))
    cells = left.join(right.hint("merge"), ["i", "j"]).repartition(max(1, min(blocks * (blocks + 1) // 2, 4 * o.sparkSession.sparkContext.defaultParallelism)), "i", "j")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                i, j, a, b = (batch.column(c)[k].as_py() for c in range(4))
                for x in range(0, len(a), block):
                    for y in range(x if i == j else 0, len(b), block):
                        yield from _confident(a[x : x + block], b[y : y + block], i == j and x == y)

    return cells.mapInArrow(run, "left string, right string, confidence double")


def cross_system_candidates(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """cross_system_pairs of tables (table_name) and columns (table_name, column_name, data_type)."""
    c = columns.groupBy("table_name").agg(F.collect_list(F.struct(F.col("column_name").alias("name"), "data_type")).alias("columns"))
    return cross_system_pairs(tables.join(c, "table_name", "left").select(F.col("table_name").alias("id"), F.lit("Table").alias("kind"), F.col("table_name").alias("name"), "columns"))


def free_text_matches(names: DataFrame, texts: DataFrame, most: int = FREE_TEXT_MOST) -> DataFrame:
    """(name_id, text_id, score): for each name the best texts (a top-k report) by the share of its words that are like a word of theirs, at least 0.3.

    Words are alike at a Jaro-Winkler of 0.90, which needs a Jaro of 5/6 and so half the letters of the longer word. Each two different words are compared
    once, and each different name of names is matched once.
    """
    n = names.select(F.col("id").alias("name_id"), cross_system_name(F.col("name")).alias("norm")).where("norm <> ''")
    concepts = cut(n.select("norm").distinct().select("norm", F.posexplode(F.split("norm", " ")).alias("position", "word")))
    tokens = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: F.octet_length(w) >= 3))
    t = cut(texts.select(F.col("id").alias("text_id"), F.explode(tokens).alias("token")))
    cell = lambda c: F.floor(F.log2(F.length(c))).cast("int")
    w = concepts.select("word").distinct().withColumn("cell", F.explode(F.array(*[cell("word") + i for i in (-1, 0, 1)])))
    met = w.join(t.select("token").distinct().withColumn("cell", cell("token")), "cell").where((2 * F.length("word") >= F.length("token")) & (2 * F.length("token") >= F.length("word")))
    alike = met.withColumn("jw", jaro_winkler_udf("word", "token")).where(F.col("jw") >= FREE_TEXT_WORD - 1e-9).select("word", "token")
    size = concepts.groupBy("norm").agg(F.count(F.lit(1)).alias("n"))
    hits = concepts.join(alike, "word").join(t, "token").groupBy("norm", "text_id").agg(F.count_distinct("position").alias("k")).join(size, "norm").select("norm", "text_id", F.round(F.col("k") / F.col("n"), 6).alias("score"))
    best = Window.partitionBy("norm").orderBy(F.desc("score"), "text_id")
    kept = hits.where(F.col("score") >= CROSS_SYSTEM_LEAST).withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= most)
    return n.join(kept, "norm").select("name_id", "text_id", "score")


def review_links(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """(from, to, kind, status, confidence): an unconfirmed SameAs from the canonical object to each other member of groups whose names differ, with the best score of the group's pairs."""
    best = pairs.join(groups.select(F.col("id").alias("left_id"), "canonical_id"), "left_id").groupBy("canonical_id").agg(F.max("score").alias("confidence"))
    fuzzy = groups.where("not exact and id <> canonical_id").join(best, "canonical_id")
    return fuzzy.select(F.col("canonical_id").alias("from"), F.col("id").alias("to"), F.lit("SameAs").alias("kind"), F.lit("unconfirmed").alias("status"), "confidence")


def unlinked(pairs: DataFrame, relationships: DataFrame) -> DataFrame:
    """pairs (left, right) that no SameAs relationship links in either direction."""
    linked = relationships.where(F.lower("kind") == "sameas").select(F.least("from", "to").alias("_a"), F.greatest("from", "to").alias("_b")).distinct()
    return pairs.withColumn("_a", F.least("left", "right")).withColumn("_b", F.greatest("left", "right")).join(linked, ["_a", "_b"], "left_anti").drop("_a", "_b")


def review(relationships: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new relationship versions, events): decisions (id, decision) of confirmed or rejected on SameAs relationships."""
    decided = relationships.where(F.lower("kind") == "sameas").join(decisions.where(F.col("decision").isin("confirmed", "rejected")), "id")
    events = decided.select(F.col("id").alias("subject"), F.when(F.col("decision") == "confirmed", "Merged").otherwise("Modified").alias("kind"))
    return decided.withColumn("status", F.col("decision")).drop("decision"), events
