"""Session, table access and lineage cuts.

A *cut* is a Parquet table written below the folder named by
``spark.checkpoint.dir``. It survives the loss of executors, it ends the
lineage, and its size on disk is known to the optimizer, so that a join with a
small cut becomes a broadcast join by ``spark.sql.autoBroadcastJoinThreshold``
and one with a large cut a shuffle join, without a hint.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []
_CUTS: list[str] = []


@atexit.register
def _remove_own() -> None:
    for path in _OWN:
        shutil.rmtree(path, ignore_errors=True)


def build_session(name: str = "tidewire", cores: str | int = "*", memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = SparkSession.builder.appName(name).master(f"local[{cores}]")
    settings = {
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where the setting is missing a temporary folder is used, but only if the
    driver is the sole machine; on a cluster a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="tidewire-")
    _OWN.append(path)
    spark.conf.set("spark.checkpoint.dir", f"file://{path}")
    spark.sparkContext.setCheckpointDir(path)
    return f"file://{path}"


def _drop_folder(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session may be gone
        pass


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    path = new_folder(df.sparkSession, name)
    _CUTS.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def temporary_cuts(spark: SparkSession) -> Iterator[None]:
    """Deletes the cuts that were made within, at its end.

    A frame that still reads one of them can't be used afterwards, so results
    are written or counted within.
    """
    known = len(_CUTS)
    try:
        yield
    finally:
        while len(_CUTS) > known:
            _drop_folder(spark, _CUTS.pop())


def small(df: DataFrame, most_rows: int, row_bytes: int = 64) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most_rows`` rows.

    Counts the rows, so ``df`` should be a cut. Beyond the bound the frame is
    returned as it is, and the join shuffles.
    """
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
