"""Branches of a stored ledger: whole copies of its folder beside the main one, listed, merged back and deleted."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from graphloom.operators import ledger
from graphloom.session import cut

_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]*")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _at(root: str, name: str) -> str:
    if not _NAME.fullmatch(name):
        raise ValueError(f"no name of a branch: {name!r}")
    return f"{root.rstrip('/')}/{'main' if name == 'main' else 'branches/' + name}"


def create(spark: SparkSession, root: str, name: str) -> str:
    """Copies main to a branch of this name, file by file; an existing branch is an error. Gives the branch's folder."""
    target = _at(root, name)
    fs, to = _fs(spark, target)
    if name == "main" or fs.exists(to):
        raise FileExistsError(name)
    _, source = _fs(spark, _at(root, "main"))
    if not spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, source, fs, to, False, spark._jsc.hadoopConfiguration()):
        raise OSError(f"copy to {target}")
    return target


def names(spark: SparkSession, root: str) -> list[str]:
    """The names of all branches, sorted, main left out."""
    fs, p = _fs(spark, f"{root.rstrip('/')}/branches")
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, root: str, name: str) -> None:
    """Deletes a branch; main and unknown names are errors."""
    if name == "main" or name not in names(spark, root):
        raise FileNotFoundError(name)
    fs, p = _fs(spark, _at(root, name))
    fs.delete(p, True)


def read(spark: SparkSession, root: str, name: str = "main") -> DataFrame:
    return spark.read.parquet(_at(root, name))


def merge(spark: SparkSession, root: str, name: str, key: str = "id", order: list[str] = ("created_at", "sig"), signature: str = "sig") -> DataFrame:
    """Appends to main the branch's current rows whose key main lacks; gives (key, outcome) of every key of the branch. Conflicts stay as main has them."""
    main, branch = (ledger.latest(read(spark, root, n), key, list(order)) for n in ("main", name))
    outcome = cut(ledger.merge_branch(main, branch, key, signature))
    ledger.append(branch.join(outcome.where("outcome = 'added'").select(key), key, "left_semi"), _at(root, "main"))
    return outcome
