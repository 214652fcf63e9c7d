"""SparkSession helpers.

The library never creates a session behind the caller's back: every
operator takes DataFrames.  ``get_spark`` is a convenience for scripts and
tests; on a cluster the caller brings its own session and only
``ensure_checkpoint_dir`` touches its settings (and only when unset).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings that matter for the plans in this package.  AQE is what turns
# sort-merge joins of small aggregated sides into broadcast joins at run
# time (a size check on real shuffle statistics), splits skewed join
# partitions and coalesces tiny shuffle partitions.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Coalesce shuffle partitions to the advisory size (64 MB unless the
    # caller sets ``spark.sql.adaptive.advisoryPartitionSizeInBytes``)
    # rather than keeping one small partition per core: post-aggregate
    # stages over a few thousand groups run as one or two tasks instead of
    # dozens of near-empty ones, and on a busy cluster the task count
    # follows the data volume.
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "tillroll", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings above."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared folder; without it
    this raises, since a folder of one machine would lose data.  Only a
    single-machine session (``local[...]``) gets a scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tillroll-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def new_scratch(spark: SparkSession) -> str:
    """Path of a folder of its own in the checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch_dir(spark: SparkSession) -> Iterator[str]:
    """A folder of its own in the checkpoint folder, removed afterwards: for
    tables that one computation writes and reads before it returns."""
    path = new_scratch(spark)
    try:
        yield path
    finally:
        remove_folder(spark, path)


_KEPT: list[DataFrame] = []


def kept(df: DataFrame) -> DataFrame:
    """``df`` persisted for results that read it more than once, until
    :func:`release_kept`."""
    df = df.persist()
    _KEPT.append(df)
    return df


def release_kept() -> None:
    """Drop all tables that operators keep for results already computed."""
    while _KEPT:
        _KEPT.pop().unpersist()


def default_parallelism(spark: SparkSession) -> int:
    """Shuffle partition count of the session, used to size bucket counts."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
