"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A-Z and a-z, for lower-casing ASCII letters only.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Most rows of a table that is sent to every executor, and most bytes that they are reckoned to take there.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
#: Most rows and bytes of a batch that goes to a Python worker.
BATCH_ROWS, BATCH_BYTES = 1_000, 16 << 20


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def let_workers_import(spark: SparkSession) -> None:
    """Python workers that see this machine's files import this package from where the driver has it, and get bounded batches.

    On a cluster the package is installed or sent with ``--py-files``; the path is harmless there. A batch is held
    several times over (in the JVM, as Arrow and as Python's objects), so a session's larger bounds are lowered.
    """
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([*filter(None, paths), root])
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        if not 0 < int(spark.conf.get(key).removesuffix("b")) <= most:
            spark.conf.set(key, str(most))


def set_checkpoint_dir(spark: SparkSession) -> None:
    """Have a folder for checkpoints: the one in ``spark.checkpoint.dir``, which all executors share.

    Where that is unset a local run gets a temporary folder; a cluster is refused,
    because a machine's own folder is not seen by the other executors.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` now, keep it in the shared checkpoint folder and forget how it was made."""
    set_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(df: DataFrame) -> DataFrame:
    """Like :func:`cut`; the shuffle files it was made from go at once, not when the driver happens to collect its garbage.

    A new frame is run, so none that the caller holds loses its files.
    """
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        return cut(df.select("*"))
    finally:
        conf.set(name, before) if before is not None else conf.unset(name)


def written(df: DataFrame) -> DataFrame:
    """``df``, written as Parquet to a new folder beside the checkpoints and read again."""
    set_checkpoint_dir(df.sparkSession)
    out = f"{df.sparkSession.sparkContext.getCheckpointDir()}/written-{uuid.uuid4().hex}"
    df.write.parquet(out)
    return df.sparkSession.read.parquet(out)


def broadcast_if_small(df: DataFrame, row_bytes: int = 100, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows, and ``BROADCAST_BYTES`` at ``row_bytes`` each; else as it is.

    Rows are counted in the tasks. Without the hint Spark joins by shuffle and
    adaptive execution splits the skewed partitions of the other side.
    """
    most = min(most, BROADCAST_BYTES // row_bytes)
    return F.broadcast(df) if df.count() <= most else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, made from ``name``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
