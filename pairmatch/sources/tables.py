"""Readers, writers and load-time contracts."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAIR_KEYS = ("id1", "id2")


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "table") -> DataFrame:
    """Fail on missing columns before any job runs."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing columns: {missing}")
    return df


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Parquet scan of the named columns."""
    return require_columns(spark.read.parquet(path), columns, path).select(*columns)


def write_parquet(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    row_group_bytes: int | None = None,
    overwrite: bool = False,
) -> None:
    """ZSTD Parquet; refuses to replace an existing table unless told to."""
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    writer = writer.option("compression", "zstd")
    if row_group_bytes:
        writer = writer.option("parquet.block.size", str(row_group_bytes))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_predictions(scored: DataFrame, path: str, overwrite: bool = False) -> None:
    """CSV ``id1,id2,predict``; the output committer publishes complete files only."""
    require_columns(scored, (*PAIR_KEYS, "predict"), "predictions")
    (
        scored.select(*PAIR_KEYS, "predict")
        .write.mode("overwrite" if overwrite else "errorifexists")
        .csv(path, header=True)
    )


def union_folds(folds: Mapping[int, DataFrame]) -> DataFrame:
    """Stack per-fold tables and tag each row with its fold."""
    tagged = [df.withColumn("fold", F.lit(fold).cast("tinyint")) for fold, df in folds.items()]
    return reduce(DataFrame.unionByName, tagged)


def read_folds(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Scan a table written with ``partitionBy("fold")``; fold filters prune folders."""
    return read_parquet(spark, path, [*columns, "fold"])


def write_records(df: DataFrame, path: str) -> None:
    """A JSON file that holds one list of records, as the readers below take it.

    For parameter tables: one row per category, model or record. The whole list is one value.
    """
    listed = df.agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias("value"))
    listed.coalesce(1).write.text(path)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of the given schema from a JSON file of records."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """``category, weights`` from a JSON file of records."""
    return read_records(spark, path, "category string, weights array<double>")


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    """Hard-pair thresholds per category from a JSON file of records."""
    schema = (
        "category string, hard_negative_min_similarity double, "
        "hard_positive_max_similarity double, negative_candidates long, "
        "positive_candidates long"
    )
    return read_records(spark, path, schema)


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """``category, coefficient, intercept`` from a JSON file of records."""
    return read_records(spark, path, "category string, coefficient double, intercept double")


def fold_filter(
    df: DataFrame,
    include_fold: int | None = None,
    exclude_fold: int | None = None,
    include_inner_fold: int | None = None,
    exclude_inner_fold: int | None = None,
) -> DataFrame:
    """Keep or drop one outer and one inner fold; the filters reach the scan."""
    for column, include, exclude in (
        ("fold", include_fold, exclude_fold),
        ("inner_fold", include_inner_fold, exclude_inner_fold),
    ):
        if include is not None and exclude is not None:
            raise ValueError(f"include and exclude of {column} are mutually exclusive")
        if include is None and exclude is None:
            continue
        require_columns(df, [column], "fold filter input")
        df = df.where(F.col(column) == include if include is not None else F.col(column) != exclude)
    return df


def shard(df: DataFrame, row: Column, count: int, index: int) -> DataFrame:
    """Rows of one of ``count`` shards by source row number."""
    if count < 1 or not 0 <= index < count:
        raise ValueError("the shard index must be in [0, count)")
    return df.where(F.pmod(row, F.lit(count)) == index)


def combine(shards: Sequence[DataFrame]) -> DataFrame:
    """Vertical concatenation by column name, numeric types widened."""
    return reduce(DataFrame.unionByName, shards)
