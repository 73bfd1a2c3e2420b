"""Stored layouts that later jobs profit from: buckets, fold folders, footers, ordered files."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmatch.operators.ranking import ordinal
from pairmatch.session import shared_folder, shuffle_width
from pairmatch.sources.tables import PAIR_KEYS, require_columns


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# -- buckets ---------------------------------------------------------------------------


def write_bucketed(df: DataFrame, key: str, buckets: int | None = None, path: str | None = None) -> DataFrame:
    """Write ``df`` in buckets of ``key``, sorted in each, and read it back as a bucketed table.

    Joins and groupings on ``key`` then read it without an exchange. The rows are dealt to
    their buckets before they are written, so a bucket is one file. By default there are as
    many buckets as a shuffle of the session has partitions, so that the other side of a
    join is dealt to match.
    """
    spark = df.sparkSession
    require_columns(df, [key], "bucketed table")
    buckets = buckets or shuffle_width(spark)
    name = f"bucketed_{uuid.uuid4().hex}"
    (
        df.repartition(buckets, key)
        .write.bucketBy(buckets, key)
        .sortBy(key)
        .option("path", path or new_path(spark, name))
        .saveAsTable(name)
    )
    return spark.table(name)


def bucketed_pair_join(pairs: DataFrame, items: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Both items of each pair from one bucketed item table: ``category, left_<f>, right_<f>``.

    Two merge joins, each of which shuffles the pairs alone; the items, the large side of a
    catalogue, stay where they are. ``items(id, category, <fields>)`` come from
    ``write_bucketed`` on ``id``. Pairs of unknown items are left out.
    """
    left = items.select(F.col("id").alias("id1"), "category", *[F.col(f).alias(f"left_{f}") for f in fields])
    right = items.select(F.col("id").alias("id2"), *[F.col(f).alias(f"right_{f}") for f in fields])
    rest = [c for c in pairs.columns if c not in (*PAIR_KEYS, "category")]
    # The merge keeps the buckets' order in use; it broadcasts nothing, whatever the sizes.
    joined = pairs.drop("category").join(left.hint("merge"), "id1").join(right.hint("merge"), "id2")
    return joined.select(
        *PAIR_KEYS, *rest, "category", *[f"{side}_{f}" for f in fields for side in ("left", "right")]
    )


# -- footers ---------------------------------------------------------------------------


def footer_summary(spark: SparkSession, path: str, columns: Sequence[str] = (), partition: str | None = None) -> DataFrame:
    """``rows`` and ``min_<c>``, ``max_<c>`` of a Parquet table from its footers alone.

    No page of data is read. Statistics exist for whole numbers, and not for strings; with
    ``partition`` there is one row per folder value. The reader that answers from footers is
    picked by two settings, so the query runs in a session of its own on the same cluster.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    table = own.read.parquet(path)
    require_columns(table, [*columns, *([partition] if partition else [])], path)
    wanted = [F.count(F.lit(1)).alias("rows")]
    for c in columns:
        wanted += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    return (table.groupBy(partition) if partition else table.groupBy()).agg(*wanted)


# -- fold folders ----------------------------------------------------------------------


def write_folds(df: DataFrame, path: str, fold: str = "fold") -> None:
    """Write one folder per fold (``fold=0`` ...), each dealt over as many files as it has rows for."""
    require_columns(df, [fold], "fold table")
    df.repartition(fold, F.pmod(F.xxhash64(*PAIR_KEYS), F.lit(4))).write.partitionBy(fold).parquet(path)


def read_selected_folds(spark: SparkSession, path: str, selected: DataFrame, fold: str = "fold") -> DataFrame:
    """The rows of the folds in ``selected(fold)``; the other folders are not opened.

    The folds are known at run time only: the planner reads them first and prunes the folders
    by them, where ``selected`` is filtered. It is broadcast for that as its distinct folds,
    at most as many as there are folders.
    """
    rows = spark.read.parquet(path)
    known = rows.schema[fold].dataType
    folds = selected.select(F.col(fold).cast(known).alias(fold)).distinct()
    return rows.join(F.broadcast(folds), fold, "left_semi").select(rows.columns)


def fold_contract(df: DataFrame, scores: Sequence[str], fold: str = "fold", keys: Sequence[str] = PAIR_KEYS) -> DataFrame:
    """Per fold: ``rows, null_keys, missing_scores, repeated_keys, valid``.

    A score is missing if it is null, NaN or infinite; a key is repeated where it has several
    rows in its fold.
    """
    none = F.lit(False)
    for s in scores:
        value = F.col(s).cast("double")
        none = none | value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | F.col(k).isNull()
    per_key = df.groupBy(fold, *keys).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(none).alias("_missing"), F.max(null_key).alias("_null")
    )
    bad = ("null_keys", "missing_scores", "repeated_keys")
    found = per_key.groupBy(fold).agg(
        F.sum("_n").alias("rows"),
        F.sum(F.when(F.col("_null"), F.col("_n")).otherwise(0)).alias(bad[0]),
        F.sum("_missing").alias(bad[1]),
        F.sum(F.when(F.col("_null"), 0).otherwise(F.col("_n") - 1)).alias(bad[2]),
    )
    return found.withColumn("valid", sum((F.col(b) for b in bad), F.lit(0)) == 0)


def union_valid_folds(df: DataFrame, scores: Sequence[str], fold: str = "fold") -> DataFrame:
    """``df`` after its folds passed ``fold_contract``; a fold that fails it fails the job."""
    wrong = fold_contract(df, scores, fold).where(~F.col("valid")).orderBy(fold).limit(1).collect()
    if wrong:
        raise ValueError(f"a fold breaks its contract: {wrong[0].asDict()}")
    return df


# -- ordered files ---------------------------------------------------------------------


def numbered_request(request: DataFrame, order: Sequence[Column], out: str = "row") -> DataFrame:
    """The request with its row number from 0, in the order that its answer has to keep."""
    return ordinal(request, [], order, out).withColumn(out, F.col(out) - 1)


def write_ordered(rows: DataFrame, path: str, row: str = "row", files: int | None = None) -> None:
    """CSV files of ``id1, id2, predict`` in ascending ``row``, over several files.

    Rows are dealt by ranges of their number and sorted, so the files in the order of their
    names hold the request's order without any task that sees all rows.
    """
    require_columns(rows, (*PAIR_KEYS, "predict", row), "ordered predictions")
    files = files or shuffle_width(rows.sparkSession)
    dealt = rows.repartitionByRange(files, row).sortWithinPartitions(row)
    dealt.select(*PAIR_KEYS, "predict").write.csv(path, header=True)


def read_ordered(spark: SparkSession, path: str, schema: str, out: str = "row") -> DataFrame:
    """The rows of ordered files with their position from 0, by file name and place in the file."""
    spread = spark.read.schema(schema).csv(path, header=True)
    # Rows of one piece of a file come in their order, whichever task reads the piece.
    placed = spread.select(
        "*",
        F.col("_metadata.file_name").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
    )
    # The file's own number leads its name.
    order = [F.col("_file"), F.col("_block"), F.col("_at")]
    return numbered_request(placed, order, out).drop("_file", "_block", "_at")
