"""Session settings and the shared folder for tables written along the way."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "rankbench") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Only where the setting is absent and the session is local (tests, a laptop)
    a new temporary folder is made and announced to the session; on a cluster,
    whose machines do not share such folders, that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="rankbench-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, purpose: str) -> str:
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder; runs a job."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def task_count(spark: SparkSession) -> int:
    """Tasks that can run at once, as far as shuffles use them."""
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(shuffles, spark.sparkContext.defaultParallelism)


def spread(scan: DataFrame) -> DataFrame:
    """Deal the rows of a small scan out to all tasks.

    A small table often sits in one file with one row group, which a single
    task would read and process alone.  A scan with more splits than tasks,
    as any large table has, is returned as it is.  For scans only: looking at
    the splits must not run a job.
    """
    wanted = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() > wanted else scan.repartition(wanted)
