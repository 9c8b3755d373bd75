"""References to records that do not exist (problem 2).

Keys are hashed into key ranges and dictionary-encoded to integers within their range. For each range and
period of the reference a compressed bitmap holds the referenced codes and another the codes of targets
that exist through the whole period; reference AND-NOT parent leaves the suspects, which are decoded and
checked against the exact time of each reference. Only suspects meet the reference rows again.

Scale: what reaches a key range is one row per (key, period), pre-aggregated on the map side, so a target that
holds a third of all references counts once a period. Ranges are sized from row counts. The second join is on
(key, period), where the suspects have one row a key and period and adaptive execution splits a hot key's references.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from graphloom.functions.bitmaps import Bitmap
from graphloom.functions.ids import canonical_uuid, is_blank

RANGE_ROWS = 24_000
#: Stands for no time; later than any time in microseconds.
_NEVER = 1 << 60


def references(relationships: DataFrame, objects: DataFrame) -> DataFrame:
    """(ref_field, record_id, space, target_id, at): every reference that is neither null nor blank.

    at is the row's created_at in microseconds, null where that is null. space tells objects from evidence.
    """
    at = F.unix_micros(F.col("created_at").cast("timestamp")).alias("at")
    ends = relationships.select(
        canonical_uuid("id").alias("record_id"),
        at,
        F.explode(
            F.array(
                F.struct(F.lit("relationships.from_id").alias("ref_field"), F.lit("object").alias("space"), F.col("from_id").alias("raw")),
                F.struct(F.lit("relationships.to_id").alias("ref_field"), F.lit("object").alias("space"), F.col("to_id").alias("raw")),
            )
        ).alias("r"),
    ).select("record_id", "at", "r.*")
    listed = objects.select(
        canonical_uuid("id").alias("record_id"), at, F.lit("objects.evidence").alias("ref_field"), F.lit("evidence").alias("space"), F.explode("evidence").alias("raw")
    )
    both = ends.unionByName(listed).where(~is_blank("raw"))
    return both.select("ref_field", "record_id", "space", canonical_uuid("raw").alias("target_id"), "at")


def parents(objects: DataFrame, technologies: DataFrame, evidence: DataFrame, events: DataFrame) -> DataFrame:
    """(space, target_id, born, died): first created_at and first Deleted event of each record, in microseconds.

    A record whose rows have no created_at counts as having always existed. _NEVER stands for no row or no deletion.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    never = F.lit(_NEVER)
    born = F.coalesce(micros("created_at"), F.lit(0)).alias("born")
    rows = lambda df, space: df.where(~is_blank("id")).select(F.lit(space).alias("space"), canonical_uuid("id").alias("target_id"), born, never.alias("died"))
    gone = (
        events.where((F.lower(F.trim("kind")) == "deleted") & ~is_blank("subject") & F.col("occurred_at").isNotNull())
        .select(F.explode(F.array(F.lit("object"), F.lit("evidence"))).alias("space"), canonical_uuid("subject").alias("target_id"), never.alias("born"), micros("occurred_at").alias("died"))
    )
    return (
        rows(objects, "object").unionByName(rows(technologies, "object")).unionByName(rows(evidence, "evidence")).unionByName(gone)
        .groupBy("space", "target_id").agg(F.min("born").alias("born"), F.min("died").alias("died"))
    )


def _survivors(refs: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """One key range: encodes, builds the bitmaps of each period, subtracts, decodes."""
    columns = ["space", "target_id", "period", "born", "died"]
    if refs.empty:
        return pd.DataFrame([], columns=columns)
    codes, words = pd.factorize(pd.concat([refs["space"] + "\0" + refs["target_id"], known["space"] + "\0" + known["target_id"]], ignore_index=True))
    ref_code, known_code = codes[: len(refs)], codes[len(refs) :]
    born = np.full(len(words), _NEVER, np.int64)
    died = np.full(len(words), _NEVER, np.int64)
    born[known_code] = known["born"].to_numpy(np.int64)
    died[known_code] = known["died"].to_numpy(np.int64)
    out = []
    period = refs["period"].to_numpy(np.int64)
    order = np.argsort(period, kind="stable")
    cuts = np.flatnonzero(np.diff(period[order])) + 1
    low, high = (refs[c].to_numpy() for c in ("low", "high"))
    for rows in np.split(order, cuts):
        referenced = Bitmap.of(ref_code[rows])
        first = low[rows].min()
        last = high[rows].max()
        alive = Bitmap.of(np.flatnonzero((born <= first) & (died > last)))
        left = referenced.and_not(alive).decode()
        if len(left):
            keep = rows[np.isin(ref_code[rows], left)]
            out.append(keep)
    if not out:
        return pd.DataFrame([], columns=columns)
    rows = np.concatenate(out)
    code = ref_code[rows]
    return pd.DataFrame({"space": refs["space"].to_numpy()[rows], "target_id": refs["target_id"].to_numpy()[rows], "period": period[rows], "born": born[code], "died": died[code]})


def orphan_references(relationships: DataFrame, objects: DataFrame, technologies: DataFrame, evidence: DataFrame, events: DataFrame) -> DataFrame:
    """(ref_field, record_id, target_id, created_month): distinct references whose target does not exist at the row's created_at.

    Does not exist: no row at all, only rows with a later created_at, or a Deleted event at or before that time. A reference
    without created_at counts only if its target has no row. Null and blank are no reference. Empty tables give no rows or, for
    the tables of targets, orphans only. Repeated rows count once; extra columns are ignored.
    """
    spark = relationships.sparkSession
    n = max(1, relationships.count() * 2 + objects.count() * 3 + evidence.count())
    ranges = max(1, math.ceil(n / RANGE_ROWS))
    refs = references(relationships, objects).withColumn("period", F.coalesce(F.floor(F.col("at") / F.lit(2_592_000_000_000)), F.lit(-1)))
    key_range = F.pmod(F.xxhash64("space", "target_id"), F.lit(ranges)).cast("int")
    seen = (
        refs.groupBy("space", "target_id", "period")
        .agg(F.coalesce(F.min("at"), F.lit(0)).alias("low"), F.coalesce(F.max("at"), F.lit(0)).alias("high"))
        .withColumn("range", key_range)
    )
    known = parents(objects, technologies, evidence, events).withColumn("range", key_range)
    suspects = (
        seen.groupBy("range")
        .cogroup(known.groupBy("range"))
        .applyInPandas(lambda a, b: _survivors(a, b), "space string, target_id string, period bigint, born bigint, died bigint")
    )
    return (
        refs.join(suspects, ["space", "target_id", "period"])
        .where((F.col("born") == _NEVER) | (F.col("born") > F.col("at")) | (F.col("died") <= F.col("at")))
        .select("ref_field", "record_id", "target_id", F.date_format(F.timestamp_micros("at"), "yyyy-MM").alias("created_month"))
        .distinct()
    )


def found(*tables: DataFrame) -> DataFrame:
    """orphan_references without the period."""
    return orphan_references(*tables).select("ref_field", "record_id", "target_id").distinct()


def report(relationships: DataFrame, objects: DataFrame, technologies: DataFrame, evidence: DataFrame, events: DataFrame) -> DataFrame:
    """(ref_field, created_month, n_references, n_orphans) over distinct (field, record, target, month)."""
    month = F.date_format(F.timestamp_micros("at"), "yyyy-MM").alias("created_month")
    every = references(relationships, objects).select("ref_field", "record_id", "target_id", month).distinct().groupBy("ref_field", "created_month").agg(F.count(F.lit(1)).alias("n_references"))
    bad = orphan_references(relationships, objects, technologies, evidence, events).groupBy("ref_field", "created_month").agg(F.count(F.lit(1)).alias("n_orphans"))
    return every.join(bad, ["ref_field", "created_month"], "left").select("ref_field", "created_month", "n_references", F.coalesce("n_orphans", F.lit(0)).alias("n_orphans"))
