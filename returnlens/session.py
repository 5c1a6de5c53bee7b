"""Session settings for local runs; on a cluster the submitter's settings win."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("returnlens")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_private: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a folder of its own. On a cluster that would scatter files over the executors'
    disks, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _private:
        _private[app] = tempfile.mkdtemp(prefix="returnlens-checkpoint-")
    return _private[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, under the application's own name."""
    return f"{checkpoint_dir(spark)}/returnlens/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}-{label}"


_open: list[list[str]] = []


def settle(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write an intermediate that several branches read and continue from the written table.

    Lineage ends at files every executor can read again, and the branches see a scan with known size and columns to
    prune. Within ``scratch``, what is not to ``keep`` goes with it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    if _open and not keep:
        _open[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove, at the end, the tables settled inside and not kept; nothing that is read later may rest on them."""
    own: list[str] = []
    _open.append(own)
    try:
        yield
    finally:
        _open.pop()
        for path in own:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard_settled(spark: SparkSession) -> None:
    """Remove everything this application settled; tables read from it are gone afterwards."""
    _delete(spark, f"{checkpoint_dir(spark)}/returnlens/{spark.sparkContext.applicationId}")
