"""Session helpers: a local session for tests and a durable lineage cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """Session used by the tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pairmatch")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``; a local session may pick its own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="pairmatch-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    Used where a table feeds several later jobs (iterations, model fits) so that a
    lost executor re-reads files instead of replaying every earlier round.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def publish(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    For tables that later jobs read a few columns of: the copy is columnar and compressed,
    and a lost executor costs a re-read.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/published-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly over all tasks of a shuffle.

    For costly work on each row: a compressed file of a few MB, read by one or two tasks, may
    hold millions of rows.
    """
    return df.repartition(shuffle_width(df.sparkSession))


def unbroadcast(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is shuffled whatever size the planner expects.

    For tables of items: the planner goes by the size of their compressed files and would send
    all of their rows through the driver.
    """
    return df.hint("merge")


def task_count(spark: SparkSession, rows: int, most: int = 250_000) -> int:
    """Tasks that sort ``rows`` rows: the shuffle width, or more if a task had over ``most``."""
    return max(shuffle_width(spark), -(-rows // most))


def few_rows(df: DataFrame, most: int = 10_000) -> DataFrame:
    """``df`` as a side of a join that every task gets whole, if it has at most ``most`` rows.

    For settled tables of parameters by group: shuffled by a few keys, all rows of a group would
    be sorted in one task. Adaptive execution shuffles such a table just because it leaves most
    partitions empty.
    """
    return df.hint("broadcast") if df.limit(most + 1).count() <= most else df


def shuffle_width(spark: SparkSession) -> int:
    """How many tasks one shuffle of this session fans out to."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
