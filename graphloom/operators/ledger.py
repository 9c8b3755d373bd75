"""The versioned ledger: appends, current and past states, histories, window differences, branch merges, facts.

A version log is a DataFrame with a key, an order (time and tie-breakers) and a signature of its content. Nothing is updated in place: the current
state is a view. All operators are one shuffle on the key, or none.
"""

from __future__ import annotations

import json
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def changed_versions(log: DataFrame, key: str, order: list[str], signature: str) -> DataFrame:
    """The rows whose signature differs from that of the version before, null-safe: A, B, A keeps three rows, A, A, B two."""
    w = Window.partitionBy(key).orderBy(*order)
    return log.withColumn("_before", F.lag(signature).over(w)).withColumn("_n", F.row_number().over(w)).where((F.col("_n") == 1) | ~F.col("_before").eqNullSafe(F.col(signature))).drop("_before", "_n")


def latest(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last version of each key: one aggregation with map-side combine, no sort."""
    whole = F.struct(*[F.col(c) for c in log.columns])
    return log.groupBy(F.col(key).alias("_key")).agg(F.max_by(whole, F.struct(*order)).alias("_v")).select("_v.*")


def as_of(log: DataFrame, key: str, order: list[str], time: str, at: datetime | str) -> DataFrame:
    """The last version of each key written at or before a time."""
    return latest(log.where(F.col(time) <= F.lit(at).cast(log.schema[time].dataType)), key, order)


def as_of_join(points: DataFrame, log: DataFrame, key: str, time: str, values: list[str], tie: list[str] = ()) -> DataFrame:
    """points (key, time, ...) with the values of the log's last version at or before each point's time.

    A union of both sides and one running last value: no range join, and a key's rows are streamed.
    """
    others = [c for c in points.columns if c not in (key, time)]
    left = points.select(key, time, F.lit(1).alias("_side"), *[F.lit(None).cast(log.schema[c].dataType).alias(f"_t_{c}") for c in tie], F.lit(None).cast(log.select(F.struct(*values)).schema[0].dataType).alias("_v"), F.struct(F.lit(0), *others).alias("_p"))
    right = log.select(key, time, F.lit(0).alias("_side"), *[F.col(c).alias(f"_t_{c}") for c in tie], F.struct(*values).alias("_v"), F.lit(None).cast(left.schema["_p"].dataType).alias("_p"))
    w = Window.partitionBy(key).orderBy(time, "_side", *[f"_t_{c}" for c in tie]).rowsBetween(Window.unboundedPreceding, 0)
    return left.unionByName(right).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1").select(key, time, *[F.col(f"_p.{c}").alias(c) for c in others], *[F.col(f"_v.{c}").alias(c) for c in values])


def history(log: DataFrame, key: str, order: list[str], time: str) -> DataFrame:
    """Every version with its number, and the time until which it held (null for the current one)."""
    w = Window.partitionBy(key).orderBy(*order)
    return log.withColumn("version", F.row_number().over(w)).withColumn("valid_to", F.lead(time).over(w))


def diff_window(log: DataFrame, key: str, time: str, start: str, end: str) -> DataFrame:
    """(added, touched, unchanged) over the half-open window (start, end]: versions, distinct keys, and the tracked keys beyond these."""
    inside = (F.col(time) > F.lit(start).cast(log.schema[time].dataType)) & (F.col(time) <= F.lit(end).cast(log.schema[time].dataType))
    one = log.groupBy(key).agg(F.sum(inside.cast("bigint")).alias("n"))
    return one.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("added"), F.coalesce(F.sum((F.col("n") > 0).cast("bigint")), F.lit(0)).alias("touched"),
        F.greatest(F.count(F.lit(1)) - F.coalesce(F.sum((F.col("n") > 0).cast("bigint")), F.lit(0)), F.lit(0)).alias("unchanged"),
    )


def merge_branch(main: DataFrame, branch: DataFrame, key: str, signature: str) -> DataFrame:
    """(key, outcome) of each key of the branch: added if main lacks it, unchanged if the signatures agree, else conflict; main is never overwritten."""
    m = main.select(F.col(key), F.col(signature).alias("_main"), F.lit(True).alias("_there"))
    outcome = F.when(F.col("_there").isNull(), "added").when(F.col("_main").eqNullSafe(F.col(signature)), "unchanged").otherwise("conflict")
    return branch.join(m, key, "left").select(key, outcome.alias("outcome"))


def diff_versions(log: DataFrame, key: str, time: str, start: str, end: str) -> DataFrame:
    """(key, time, n) of the window (start, end]: the versions of each touched key, by time."""
    kind = log.schema[time].dataType
    return log.where((F.col(time) > F.lit(start).cast(kind)) & (F.col(time) <= F.lit(end).cast(kind))).groupBy(key, time).agg(F.count(F.lit(1)).alias("n"))


def relationships_at(log: DataFrame, order: list[str], time: str, at: str, nodes: DataFrame) -> DataFrame:
    """(node_id, relationship columns): relationships touching nodes (id), each as it was at a time, whatever became of it later; a self-loop once."""
    from graphloom.operators.graph import touching

    return touching(as_of(log, "id", order, time, at), nodes)


def merged(main: DataFrame, branch: DataFrame, key: str, signature: str) -> DataFrame:
    """The rows of main and those of the branch whose key main lacks."""
    return main.unionByName(branch.join(main.select(key), key, "left_anti").select(main.columns))


def commit(current: DataFrame, incoming: DataFrame, key: str, signature: str) -> DataFrame:
    """incoming with written: true where its key is new or its signature differs from the current one (append only these), else false."""
    now = current.select(F.col(key).alias("_key"), F.col(signature).alias("_now"), F.lit(True).alias("_there"))
    return incoming.join(now, F.col(key) == F.col("_key"), "left").withColumn("written", F.col("_there").isNull() | ~F.col("_now").eqNullSafe(F.col(signature))).drop("_key", "_now", "_there")


def commit_report(**parts: DataFrame) -> DataFrame:
    """(entry_type, n_written, n_skipped) of commits by entry type."""
    out = None
    for name, df in parts.items():
        one = df.agg(F.lit(name).alias("entry_type"), F.coalesce(F.sum(F.col("written").cast("bigint")), F.lit(0)).alias("n_written"), F.coalesce(F.sum((~F.col("written")).cast("bigint")), F.lit(0)).alias("n_skipped"))
        out = one if out is None else out.unionByName(one)
    return out


def counts(**tables: DataFrame) -> DataFrame:
    """(name, n_versions, n_ids) of tables with a column id."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n_versions"), F.count_distinct("id").alias("n_ids"))
        out = one if out is None else out.unionByName(one)
    return out


# --- facts: entity, attribute, position, value ---------------------------------------------------------------------

REFERENCES = {"id", "from", "to", "subject", "evidence"}
_UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


class _Lexeme(str):
    """A JSON number as written."""


def _escape(part: str) -> str:
    return part.replace("\\", "\\\\").replace(".", "\\.")


def _parts(path: str) -> list[str]:
    out, cur, i = [], "", 0
    while i < len(path):
        if path[i] == "\\":
            cur, i = cur + path[i + 1], i + 2
        elif path[i] == ".":
            out.append(cur)
            cur, i = "", i + 1
        else:
            cur, i = cur + path[i], i + 1
    return [*out, cur]


def _kind(value: object, attr: str) -> tuple[str, str | None]:
    import re

    if value is None:
        return "null", None
    if isinstance(value, bool):
        return "bool", "true" if value else "false"
    if isinstance(value, _Lexeme):
        return "number", str(value)
    if isinstance(value, str):
        return ("ref" if attr.split(".")[0] in REFERENCES and re.match(_UUID, value) else "string"), value
    return "composite", _dump(value)


def _dump(value: object) -> str:
    if isinstance(value, _Lexeme):
        return str(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_dump(v)}" for k, v in sorted(value.items())) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_dump, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def payload_facts(payload: str) -> list[tuple[str, int | None, str, str | None]]:
    """(attr, pos, value_type, value) of a JSON object: objects become dotted paths, top-level lists of references positions, numbers keep their text."""
    fields = json.loads(payload, parse_int=_Lexeme, parse_float=_Lexeme)
    out: list[tuple[str, int | None, str, str | None]] = []

    def walk(prefix: str, value: object) -> None:
        if isinstance(value, dict) and value:
            for k in sorted(value):
                walk(f"{prefix}.{_escape(k)}" if prefix else _escape(k), value[k])
        elif prefix in REFERENCES and isinstance(value, list) and value and all(isinstance(x, str) for x in value):
            out.extend((prefix, i, *_kind(x, prefix)) for i, x in enumerate(value))
        else:
            out.append((prefix, None, *_kind(value, prefix)))

    walk("", fields)
    return out


def facts_payload(facts: list[tuple[str, int | None, str, str | None]]) -> str:
    """The JSON object that facts were taken from, keys sorted; positions must run from 0 without a gap and paths must not collide."""
    tree: dict = {}
    lists: dict[str, dict[int, str]] = {}
    read = {"null": lambda v: "null", "bool": lambda v: v, "number": lambda v: v, "composite": lambda v: v}

    def put(path: str, text: str) -> None:
        at, names = tree, _parts(path)
        for n in names[:-1]:
            at = at.setdefault(n, {})
            if not isinstance(at, dict):
                raise ValueError(f"path conflict at {path}")
        if names[-1] in at:
            raise ValueError(f"path conflict at {path}")
        at[names[-1]] = text

    for attr, pos, kind, value in facts:
        text = read.get(kind, lambda v: json.dumps(v, ensure_ascii=False))(value)
        if pos is None or pos != pos:
            put(attr, text)
        else:
            lists.setdefault(attr, {})[int(pos)] = text
    for attr, items in lists.items():
        if sorted(items) != list(range(len(items))):
            raise ValueError(f"positions of {attr}")
        put(attr, "[" + ",".join(items[i] for i in range(len(items))) + "]")

    def text(node: object) -> str:
        return node if isinstance(node, str) else "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{text(v)}" for k, v in sorted(node.items())) + "}"

    return text(tree)


def decompose(entries: DataFrame) -> DataFrame:
    """(entity, attr, pos, value_type, value) of entries (id, payload); payloads that are no JSON object have no facts."""

    def run(batches):
        for pdf in batches:
            out = []
            for i, p in zip(pdf["id"], pdf["payload"]):
                try:
                    out += [(i, *f) for f in payload_facts(p)] if isinstance(p, str) and p.lstrip().startswith("{") else []
                except ValueError:
                    pass
            frame = pd.DataFrame(out, columns=["entity", "attr", "pos", "value_type", "value"])
            frame["pos"] = frame["pos"].astype("Int32")
            yield frame

    return entries.select("id", "payload").mapInPandas(run, "entity string, attr string, pos int, value_type string, value string")


def reconstruct(facts: DataFrame) -> DataFrame:
    """(entity, payload): the inverse of decompose; one aggregation of an entity's facts, then text."""
    listed = facts.groupBy("entity").agg(F.collect_list(F.struct("attr", "pos", "value_type", "value")).alias("f"))

    @F.pandas_udf("string")
    def text(rows: pd.Series) -> pd.Series:
        return pd.Series([facts_payload([(f["attr"], f["pos"], f["value_type"], f["value"]) for f in r]) for r in rows])

    return listed.select("entity", text("f").alias("payload"))


def fact_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(entity, attr, pos, op, value_type, value): retracts of what is gone or replaced, asserts of what is new."""
    key = ["entity", "attr", "pos"]
    side = lambda df, p: df.select(*[F.col(c).alias(f"{p}{c}") for c in [*key, "value_type", "value"]])
    on = F.lit(True)
    for c in key:
        on = on & F.col(f"o{c}").eqNullSafe(F.col(f"n{c}"))
    both = side(old, "o").join(side(new, "n"), on, "full")
    same = F.col("ovalue").eqNullSafe(F.col("nvalue")) & F.col("ovalue_type").eqNullSafe(F.col("nvalue_type"))
    op = lambda p, name: F.when(F.col(f"{p}entity").isNotNull(), F.struct(*[F.col(f"{p}{c}").alias(c) for c in key], F.lit(name).alias("op"), F.col(f"{p}value_type").alias("value_type"), F.col(f"{p}value").alias("value")))
    return both.where(~same).select(F.explode(F.array_compact(F.array(op("o", "retract"), op("n", "assert")))).alias("x")).select("x.*")


def fold_facts(facts: DataFrame, until: Column | None = None) -> DataFrame:
    """The asserted facts at a transaction: the last operation of each (entity, attr, pos) by (tx, ordinal) that is no retraction."""
    rows = facts if until is None else facts.where(F.col("tx") <= until)
    last = rows.groupBy("entity", "attr", "pos").agg(F.max_by(F.struct("op", "value"), F.struct("tx", "ordinal")).alias("v"))
    return last.where("v.op = 'assert'").select("entity", "attr", "pos", F.col("v.value").alias("value"))


#: The keys facts are sorted by for scans by entity, by attribute and by reference, and the runs of an order before they are compacted; fixed values.
ORDERS = {"eavt": ["entity", "attr", "tx"], "aevt": ["attr", "entity", "tx"], "avet": ["attr", "value", "entity", "tx"]}
MOST_RUNS = 8


def scan(facts: DataFrame, order: str, *prefix: str) -> DataFrame:
    """The facts under a prefix of an order: (entity[, attr]) of eavt, (attr[, entity]) of aevt, (attr[, value]) of avet, which has references only.

    Plain equalities, so that they reach the scan of files that compact wrote in this order.
    """
    rows = facts.where("value_type = 'ref'") if order == "avet" else facts
    for c, v in zip(ORDERS[order], prefix):
        rows = rows.where(F.col(c) == F.lit(v))
    return rows


def write_index(facts: DataFrame, root: str, files: int = 8) -> None:
    """Adds one sorted run of facts to each order under root."""
    import uuid

    for order, keys in ORDERS.items():
        run = facts.where("value_type = 'ref'") if order == "avet" else facts
        compact(run, f"{root}/{order}/run={uuid.uuid4().hex}", keys, files)


def compact_runs(spark, root: str, order: str, files: int = 8, most: int = MOST_RUNS) -> int:
    """Merges the runs of an order into one where there are more than most; gives the number of runs then. The old runs go only after the new one is whole."""
    import uuid

    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{order}")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    runs = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("run=")]
    if len(runs) <= most:
        return len(runs)
    compact(spark.read.parquet(*[r.toString() for r in runs]), f"{root}/{order}/run={uuid.uuid4().hex}", ORDERS[order], files)
    for r in runs:
        fs.delete(r, True)
    return 1


def compact(df: DataFrame, path: str, keys: list[str], files: int) -> None:
    """Rewrites runs as sorted files, so that min/max statistics prune scans by entity, attribute or reference."""
    df.repartitionByRange(files, *keys).sortWithinPartitions(*keys).write.mode("overwrite").option("compression", "zstd").parquet(path)


def export_json(df: DataFrame, path: str) -> None:
    """A ledger as JSON lines, times in microseconds, to be read by import_json or anything else."""
    df.write.mode("overwrite").options(compression="gzip", ignoreNullFields=False, **_TIMES).json(path)


def import_json(spark, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).options(**_TIMES).json(path)


_TIMES = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def append(df: DataFrame, path: str) -> None:
    """Appends rows to a ledger folder partitioned by entry_type; Spark's commit protocol makes it all or nothing."""
    df.write.mode("append").partitionBy("entry_type").option("compression", "zstd").parquet(path)


def write_once(df: DataFrame, path: str, key: str) -> None:
    """Appends the rows whose key the folder does not have yet."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        df = df.join(spark.read.parquet(path).select(key), key, "left_anti")
    df.dropDuplicates([key]).write.mode("append").option("compression", "zstd").parquet(path)
