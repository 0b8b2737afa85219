"""Tables in the shared checkpoint folder: cuts lineage in loops and survives lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or else by ``setCheckpointDir``."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="spark-checkpoint-")  # one machine, as in tests
    spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Spark deletes a query's shuffle files as it ends, instead of when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _held(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialized(df: DataFrame, settings: dict[str, str] | None = None) -> DataFrame:
    """``df`` as a table of its own; once it is written, its shuffles hold no disk any more. ``settings`` hold for the write."""
    path = f"{shared_folder(df.sparkSession)}/step-{uuid.uuid4().hex}"
    with _held(df.sparkSession, {CLEANUP: "true"} | (settings or {})):
        df.write.option("compression", "zstd").parquet(path)  # shas are hex digits, which zstd halves
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(*tables: DataFrame) -> None:
    """Delete tables made by ``materialized``, once all that is to come from them is written itself."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(path, True)
