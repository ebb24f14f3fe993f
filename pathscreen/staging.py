"""Intermediate tables in the shared folder, for inputs that several branches of a job read."""
from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from pathscreen.session import checkpoint_dir

_OPEN: list[Scope] = []


class Scope:
    """The folders that were staged while it was open."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folders = spark, []

    def remove(self) -> None:
        """Deletes the folders; frames that read them must have been written before."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        while self.folders:
            path = jvm.org.apache.hadoop.fs.Path(self.folders.pop())
            path.getFileSystem(conf).delete(path, True)


@contextmanager
def staging(spark: SparkSession) -> Iterator[Scope]:
    """Collects what is staged inside; call ``remove()`` on the scope once the results are written."""
    scope = Scope(spark)
    _OPEN.append(scope)
    try:
        yield scope
    finally:
        _OPEN.remove(scope)


def stage(df: DataFrame) -> DataFrame:
    """Write once, read back: the lineage ends here, columns prune, sizes are known to the planner.

    Runs a job. The table lies in the folder named by ``spark.checkpoint.dir`` and survives lost
    executors; it stays until its scope (``staging``) or the folder's owner removes it.
    """
    spark = df.sparkSession
    folder = f"{checkpoint_dir(spark)}/stage-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].folders.append(folder)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
