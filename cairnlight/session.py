"""Session factory and the two session-level services operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "cairnlight", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with adaptive execution and a UTC clock; on a cluster, pass your own session instead."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("CAIRNLIGHT_DRIVER_MEMORY", "6g"),
    } | conf
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset (tests)."""
    given = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not given:
        given = spark.conf.get("cairnlight.shared.dir", "") or ""
        if not given:
            master = spark.conf.get("spark.master", "local")
            if master != "local" and not master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            given = "file://" + tempfile.mkdtemp(prefix="cairnlight-")
            spark.conf.set("cairnlight.shared.dir", given)
    return given.rstrip("/")


_WRITTEN: dict[str, None] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str = "step", replaces: Iterable[DataFrame] = ()) -> DataFrame:
    """Cut lineage: write to the shared folder as Parquet and read it back; survives the loss of any executor.

    ``replaces`` names earlier results of this function that nothing reads any more; their files go once the new ones
    are whole. What is left when the caller has its results goes with ``scratch``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cairnlight/{name}-{uuid.uuid4().hex}"
    _WRITTEN[path] = None
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # files of this job's shuffles go when it ends: nothing reads them again
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    discard(spark, *(x.written_to for x in replaces if hasattr(x, "written_to")))
    return out


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete files that ``materialize`` wrote."""
    for path in paths:
        if _WRITTEN.pop(path, path) is None:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes on leaving what was materialized inside, but for frames that were given to the function it yields: write or
    collect all other results before."""
    before, kept = set(_WRITTEN), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.written_to)
        return df

    try:
        yield keep
    finally:
        discard(spark, *(p for p in list(_WRITTEN) if p not in before and p not in kept))
