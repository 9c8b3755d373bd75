"""Orphan references, hierarchies and drifting schemas: brute force, edge cases, hot keys."""

import json
import random
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions.bitmaps import Bitmap
from graphloom.operators import drift, hierarchy, orphans
from graphloom.session import cut
from tests.conftest import rows

OBJ = "id string, obj_name string, kind string, evidence array<string>, created_at timestamp_ntz, space string, born string"
REL = "id string, kind string, from_id string, to_id string, created_at timestamp_ntz, period string, target_id string"
T0 = datetime(2024, 1, 1)


def uid(n):
    return f"{n:08x}-0000-4000-8000-000000000000"


def test_bitmaps_subtract():
    rng = np.random.default_rng(3)
    for n, m in ((10, 5), (60_000, 50_000), (5_000, 90_000), (0, 4)):
        a, b = rng.integers(0, 200_000, n), rng.integers(0, 200_000, m)
        got = Bitmap.of(a).and_not(Bitmap.of(b))
        assert got.decode().tolist() == sorted(set(a.tolist()) - set(b.tolist()))
        assert len(got) == len(got.decode())


def _tables(spark, objects, relationships, technologies=(), evidence=(), events=()):
    one = "id string, created_at timestamp_ntz"
    return (
        spark.createDataFrame(relationships, REL), spark.createDataFrame(objects, OBJ), spark.createDataFrame(list(technologies), one),
        spark.createDataFrame(list(evidence), one), spark.createDataFrame(list(events), "subject string, kind string, occurred_at timestamp_ntz"),
    )


def test_orphans_edges(spark, monkeypatch):
    monkeypatch.setattr(orphans, "RANGE_ROWS", 4)
    o = [(uid(1), "a", "T", [uid(9), None, " ", "broken", uid(8), uid(8)], T0, "x", "y"), (uid(2), "b", "T", None, T0 + timedelta(days=5), "x", "y"), (uid(1), "a", "T", [], T0 + timedelta(days=9), "x", "y")]
    r = [
        (uid(100), "k", uid(1), uid(2), T0 + timedelta(days=1), "p", "q"),  # to comes later
        (uid(101), "k", uid(1).upper(), "{" + uid(2) + "}", T0 + timedelta(days=6), "p", "q"),  # both there
        (uid(102), "k", None, "", T0, "p", "q"),
        (uid(103), "k", "no uuid", uid(50), None, "p", "q"),  # technology exists; no time
        (uid(104), "k", uid(1), uid(3), T0 + timedelta(days=20), "p", "q"),  # 3 deleted at just that time
        (uid(104), "k", uid(1), uid(3), T0 + timedelta(days=20), "p", "q"),
        (uid(105), "k", uid(3), uid(1), T0 + timedelta(days=19), "p", "q"),
    ]
    o.append((uid(3), "c", "T", [], T0, "x", "y"))
    got = rows(orphans.found(*_tables(spark, o, r, [(uid(50), T0)], [(uid(9), T0), (uid(8), T0 + timedelta(days=1))], [(uid(3), "DELETED", T0 + timedelta(days=20)), (None, "Deleted", T0)])))
    assert got == sorted([
        ("objects.evidence", uid(1), uid(8)), ("objects.evidence", uid(1), "broken"), ("relationships.from_id", uid(103), "no uuid"),
        ("relationships.to_id", uid(100), uid(2)), ("relationships.to_id", uid(104), uid(3)),
    ], key=str)


def test_orphans_empty(spark):
    assert rows(orphans.found(*_tables(spark, [], []))) == []
    assert rows(orphans.report(*_tables(spark, [], []))) == []
    assert rows(orphans.found(*_tables(spark, [], [(uid(1), "k", uid(2), uid(2), T0, "", "")]))) == [("relationships.from_id", uid(1), uid(2)), ("relationships.to_id", uid(1), uid(2))]


def test_orphans_brute_force_with_hot_target(spark, monkeypatch):
    monkeypatch.setattr(orphans, "RANGE_ROWS", 20)
    rng = random.Random(5)
    day = lambda: T0 + timedelta(days=rng.randrange(200), hours=rng.randrange(24))
    o = [(uid(i), "n", "k", [], day(), "", "") for i in rng.choices(range(40), k=60)]
    r = [(uid(1000 + i), "k", uid(rng.randrange(50)), uid(7 if rng.random() < 0.4 else rng.randrange(50)), day(), "", "") for i in range(400)]
    ev = [(uid(rng.randrange(50)), rng.choice(["Deleted", "Modified"]), day()) for _ in range(12)]
    want = set()
    for i, _, a, b, t, *_ in r:
        for f, x in (("relationships.from_id", a), ("relationships.to_id", b)):
            born = [c for n, _, _, _, c, *_ in o if n == x]
            gone = [c for n, k, c in ev if n == x and k == "Deleted" and c <= t]
            if not born or min(born) > t or gone:
                want.add((f, i, x))
    assert set(map(tuple, rows(orphans.found(*_tables(spark, o, r, events=ev))))) == want


def _links(spark, pairs, kind="Contains"):
    return spark.createDataFrame([(uid(i), kind, a, b, T0, "", "") for i, (a, b) in enumerate(pairs)], REL)


def _brute(pairs):
    up = {}
    for p, c in pairs:
        up[c] = min(p, up.get(c, p))
    nodes = {n for pair in pairs for n in pair}
    out = {}
    for n in nodes:
        path = [n]
        while path[-1] in up and up[path[-1]] not in path:
            path.append(up[path[-1]])
        if path[-1] in up:
            out[n] = (min(path[path.index(up[path[-1]]) :]), -1)
        else:
            out[n] = (path[-1], len(path) - 1)
    return out


@pytest.mark.parametrize("bucket", [1000, 7, 2])
def test_hierarchy_brute_force(spark, bucket):
    rng = random.Random(bucket)
    pairs = [(uid(rng.randrange(max(1, i))), uid(i)) for i in range(1, 50)] + [(uid(100 + i), uid(101 + i)) for i in range(23)]
    pairs += [(uid(200), uid(201)), (uid(201), uid(202)), (uid(202), uid(200)), (uid(202), uid(210)), (uid(210), uid(211)), (uid(300), uid(300))]
    pairs += pairs[:5] + [(uid(400), uid(401 + i)) for i in range(30)]
    got = {n: (r, d) for n, r, d in rows(hierarchy.hierarchy(_links(spark, pairs), bucket=bucket))}
    assert got == _brute(pairs)
    paths = {r["node_id"]: r["path"] for r in hierarchy.hierarchy(_links(spark, pairs), True, bucket).collect()}
    up = {c: p for p, c in pairs}
    for n, (root, depth) in got.items():
        if depth < 0:
            assert paths[n] is None
        else:
            assert paths[n][0] == root and paths[n][-1] == n and len(paths[n]) == depth + 1
            assert all(up[b] == a for a, b in zip(paths[n], paths[n][1:]))


@pytest.mark.parametrize("bucket", [10_000, 150, 30])
def test_cycles_over_several_buckets(spark, bucket):
    rng = random.Random(bucket)
    ids = [uid(n) for n in rng.sample(range(1_000_000), 1_000)]
    pairs, at = [], 0
    for n in (1, 2, 3, 17, 120):
        ring = ids[at : at + n]
        at += n
        pairs += [(ring[i], ring[(i + 1) % n]) for i in range(n)]
        for _ in range(3):  # tails of several lengths below the cycle, with ids smaller and larger than its own
            tail = [rng.choice(ring), *ids[at : at + 12]]
            at += 12
            pairs += list(zip(tail, tail[1:]))
    chain = ids[at : at + 100]
    pairs += list(zip(chain, chain[1:]))
    rng.shuffle(pairs)
    want = _brute(pairs)
    found = hierarchy.hierarchy(_links(spark, pairs), bucket == 150, bucket).collect()
    assert {r["node_id"]: (r["root_id"], r["depth"]) for r in found} == want
    assert bucket != 150 or all((r["path"] is None) == (r["depth"] < 0) for r in found)


def test_hierarchy_edges(spark):
    assert rows(hierarchy.hierarchy(_links(spark, []))) == []
    df = spark.createDataFrame([(uid(1), "CONTAINS", None, uid(2), T0, "", ""), (uid(2), "contains", "{" + uid(3) + "}", uid(4).replace("-", ""), T0, "", ""), (uid(3), "Calls", uid(5), uid(6), T0, "", "")], REL)
    assert rows(hierarchy.hierarchy(df)) == [(uid(3), uid(3), 0), (uid(4), uid(3), 1)]
    assert rows(hierarchy.descendants(df)) == [(uid(3), 1, 1)]


MAN = "manifest_id bigint, feed string, path string, batch_id string, body string, ingested_at timestamp_ntz, field string"


def _manifests(spark, bodies):
    return spark.createDataFrame([(i, f, "p", b, body if body is None or isinstance(body, str) else json.dumps(body), T0, "") for i, (f, b, body) in enumerate(bodies)], MAN)


def test_drift_changes(spark):
    base = {"entities": 3100, "producer": "tool 1.0", "evidence": 500}
    bodies = [
        ("f", "20240101T0000", base), ("f", "20240103T0000", base | {"evidence": None, "zones": ["a"]}), ("f", "20240103T0000", base | {"evidence": None, "zones": ["a"]}),
        ("f", "20240102T0000", base), ("f", "20240201T0000", {"entity_rows": 3104, "exporter": "tool 1.0", "evidence": "501", "zones": ["a"]}), ("f", "20240202T0000", "{broken"), ("f", "20240203T0000", None),
        ("f", "20240204T0000", {"entity_rows": 3104, "exporter": None, "evidence": "501"}), ("f", "20240205T0000", "[1]"), ("f", "20240206T0000", {"entity_rows": [3104], "exporter": "tool 1.0", "evidence": "502"}),
        ("g", "20240101T0000", {"a": 1}), (None, "20240101T0000", {"a": 2}), ("g", "20240301T0000", {}),
    ]
    assert rows(drift.changes(_manifests(spark, bodies))) == sorted([
        ("f", "20240103T0000", "zones", "added"), ("f", "20240201T0000", "entities", "renamed"), ("f", "20240201T0000", "producer", "renamed"), ("f", "20240201T0000", "evidence", "retyped"),
        ("f", "20240204T0000", "zones", "removed"), ("f", "20240206T0000", "entity_rows", "retyped"), ("g", "20240301T0000", "a", "removed"),
    ], key=str)


def test_drift_long_contents(spark):
    for n in (20, 80, 4000):
        old, new = {"row_counts": [1000 + i for i in range(n)]}, {"counts_of_rows": [1001 + i for i in range(n)]}
        got = rows(drift.changes(_manifests(spark, [("f", "a", old), ("f", "b", new)])))
        assert got == [("f", "b", "row_counts", "renamed")], n


def test_drift_does_not_depend_on_chunks(spark):
    rng = random.Random(12)
    bodies = []
    for i in range(60):  # batch ids of no date; fields null for long, so that the next value lies in a later chunk
        body = {"entities": None if i % 7 else 3000 + i, "producer" if i < 31 else "exporter": None if 25 < i < 45 else "tool 1.0", "zones": rng.choice([None, ["a"], "a"])}
        bodies.append(("hot" if i % 3 else "f", f"run {i:05d}", body))
    whole = rows(drift.changes(_manifests(spark, bodies), 1))
    assert len(whole) > 5 and all(rows(drift.changes(_manifests(spark, bodies), n)) == whole for n in (7, 40))


def test_more_fields_than_columns(spark):
    m = _manifests(spark, [("f", "1", {"a": 1, "b": "x", "c": [1]}), ("f", "2", {"a": 2, "b": None})])
    t = {r["batch_id"]: r.asDict() for r in drift.consistent_table(m, 1).collect()}
    assert t["1"]["f_a"] == 1.0 and t["1"]["rest"] == {"b": '"x"', "c": "[1]"} and t["2"]["rest"] == {"b": None} and "f_b" not in t["1"]
    assert "rest" not in drift.consistent_table(m, 3).columns


def test_drift_empty_and_schema(spark):
    assert rows(drift.changes(_manifests(spark, []))) == []
    assert rows(drift.union_schema(_manifests(spark, []))) == []
    m = _manifests(spark, [("f", "1", {"a": 1, "b": None, "c": [1]}), ("f", "2", {"a": "x", "b": True, "c": None}), ("f", "3", {"d": "y" * 5000})])
    assert rows(drift.union_schema(m)) == [("a", "string", 2, 0), ("b", "boolean", 2, 1), ("c", "json", 2, 1), ("d", "string", 1, 0)]
    t = {r["batch_id"]: r for r in drift.consistent_table(m).collect()}
    assert t["1"]["f_a"] == "1" and t["2"]["f_b"] is True and t["1"]["f_c"] == "[1]" and len(t["3"]["f_d"]) == 5000 and t["3"]["f_a"] is None


def test_promotion_is_a_lattice():
    kinds = ["void", "boolean", "double", "string", "json"]
    for a in kinds:
        assert drift.promote(a, a) == a
        for b in kinds:
            assert drift.promote(a, b) == drift.promote(b, a)
            for c in kinds:
                assert drift.promote(drift.promote(a, b), c) == drift.promote(a, drift.promote(b, c))


def test_cut_forgets_sizes_beyond_any_real_one(spark):
    links = cut(spark.range(300).select("id", (F.col("id") + 1).alias("to")))
    for _ in range(9):
        on = links.select(F.col("id").alias("to"), F.col("to").alias("next"))
        links = cut(links.join(on, "to", "left").select("id", F.coalesce("next", "to").alias("to")))
    assert links._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 63
    assert rows(links) == rows(spark.range(300).select("id", F.lit(300).cast("bigint")))


def test_cut_leaves_no_shuffle_files(spark):
    shuffled = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {b.toString() for b in _each(blocks.getAllFiles()) if b.getName().startswith("shuffle_")}
    before = files()
    done = cut(shuffled)
    deadline = time.time() + 10
    while files() - before and time.time() < deadline:
        time.sleep(0.1)
    assert not files() - before
    assert rows(done) == rows(shuffled)


def _each(found):
    return [found.apply(i) for i in range(found.size())]
