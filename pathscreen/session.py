"""Session settings used by the tests, the benchmark and the examples."""
from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "pathscreen") -> SparkSession:
    """A local session; a cluster brings its own session and settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder of that path (``*`` matches any name) is there, in any store that the session reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


_UNNAMED: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names. Where none is named, a local session (tests) gets a folder of this run; on a
    cluster that would be a folder that executors can't see, so there it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("name a folder that all machines share in spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if app not in _UNNAMED:
        _UNNAMED[app] = tempfile.mkdtemp(prefix="pathscreen-")
    return _UNNAMED[app]
