"""Session settings and durable intermediate results."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A session for tests and benches on one machine; a cluster brings its own session, on which ship is to be called once."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("graphloom")
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    ship(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: the cluster's own setting; only a local master may go without, and gets a temporary folder.

    A cluster that sets spark.cleaner.referenceTracking.cleanCheckpoints has its checkpoints deleted once nothing refers to them.
    """
    sc = spark.sparkContext
    at = sc.getCheckpointDir()
    if at:
        return at
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="graphloom-checkpoint-"))
    return sc.getCheckpointDir()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and returns it without lineage.

    The files outlive any executor, so iterative operators survive the loss of one. What was shuffled to make them is deleted with it,
    not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        return _unsized(df.select("*").checkpoint(eager=True))  # planned anew, so that it heeds the setting
    finally:
        spark.conf.set(_CLEANUP, before)


def _unsized(done: DataFrame) -> DataFrame:
    """done without its estimated size, if that is beyond any real one.

    A checkpoint keeps the size estimated for it, and the estimate of a join is the product of its sides. Loops that join what they cut with itself
    double the digits each round, until the driver computes with numbers of many MB.
    """
    query = done._jdf.queryExecution()
    if query.optimizedPlan().stats().sizeInBytes() < 1 << 63:
        return done
    session = done.sparkSession
    return DataFrame(session._jsparkSession.internalCreateDataFrame(query.analyzed().rdd(), done._jdf.schema(), False), session)


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores, for costly work row by row; what has enough is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application, so that Python workers can import it anywhere."""
    import os
    import zipfile

    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="graphloom-"), "graphloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(here):
            for f in files:
                if f.endswith(".py"):
                    z.write(os.path.join(folder, f), os.path.join("graphloom", os.path.relpath(os.path.join(folder, f), here)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
