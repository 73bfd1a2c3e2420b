"""Shared pieces of the training-data operators: tables, published intermediates, registry."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUN: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register ``(spark, sf_dir) -> DataFrame`` under its own name, with its SQL if there is one."""

    def add(function):
        RUN[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="llm-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def publish(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Unlike a row checkpoint the copy is compressed and columnar, so later jobs read only
    the columns they need, and a lost executor costs a re-read.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/published-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(taken: Iterable[str], name: str) -> str:
    """``name``, or the first of ``name_``, ``name__`` ... that no column carries (in any case)."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


def whole(text: Column | str) -> Column:
    """The text, with a null read as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def quoted(name: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")
