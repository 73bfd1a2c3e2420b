"""Leakage-safe splits: item hash split, samples and component folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmatch.functions.hashing import hash_slot, seeded_hash
from pairmatch.operators.audits import component_leakage, enforce
from pairmatch.operators.graph import component_ids
from pairmatch.operators.joins import with_category
from pairmatch.operators.ranking import ordinal
from pairmatch.session import settle, shuffle_width, unbroadcast


def hash_split(modulus: int = 5, bucket: int = 0, method: str = "md5") -> Column:
    """validation when both items hash to the bucket, train when neither does."""
    if modulus < 2:
        raise ValueError("modulus must be at least 2")
    if not 0 <= bucket < modulus:
        raise ValueError("the bucket is outside the modulus")
    left, right = (
        F.pmod(seeded_hash(None, side, method=method), F.lit(modulus)) == bucket
        for side in ("id1", "id2")
    )
    return (
        F.when(left & right, F.lit("validation"))
        .when(~left & ~right, F.lit("train"))
        .otherwise(F.lit("dropped_cross"))
    )


def modulus_sample(pairs: DataFrame, modulus: int, seed: int, method: str = "md5") -> DataFrame:
    """About one in ``modulus`` pairs, by pair hash."""
    if modulus < 1:
        raise ValueError("the sample modulus must be positive")
    return pairs.where(F.pmod(seeded_hash(seed, "id1", "id2", method=method), F.lit(modulus)) == 0)


def shuffle_order(df: DataFrame, seed: int, out: str = "position", method: str = "md5") -> DataFrame:
    """Position of every pair in a seeded global shuffle, without a global sort."""
    slots = shuffle_width(df.sparkSession)
    hashed = df.withColumn("_hash", seeded_hash(seed, "id1", "id2", method=method))
    numbered = ordinal(
        hashed,
        [],
        [F.col("_hash"), F.col("id1"), F.col("id2")],
        out,
        slot=hash_slot(F.col("_hash"), slots, method),
    )
    return numbered.drop("_hash")


def source_rows(df: DataFrame, out: str = "source_row") -> DataFrame:
    """Stable row ids 0..n-1 in pair-key order."""
    return ordinal(df, [], [F.col("id1"), F.col("id2")], "_n").select(
        *df.columns, (F.col("_n") - 1).alias(out)
    )


def head_by_hash(
    df: DataFrame, rows: int, seed: int, columns: Sequence[str], method: str = "md5"
) -> DataFrame:
    """The first ``rows`` rows in hashed order: per-task top-n, then a merge."""
    if rows < 1:
        raise ValueError("rows must be positive")
    order = seeded_hash(seed, *columns, method=method)
    return df.orderBy(order, *columns).limit(rows)


def component_folds(
    df: DataFrame, folds: int = 5, seed: int = 2026, out: str = "fold", method: str = "md5"
) -> DataFrame:
    """Assign whole components to folds, balanced by category and label.

    Components are ranked by size inside their dominant stratum (category and label) and
    dealt in snake order. No component crosses folds; one giant component still sits in a
    single fold, which ``summaries.fold_summary`` shows. The greedy assignment differs
    from a sequential splitter's, its guarantees do not.
    """
    if folds < 2:
        raise ValueError("folds must be at least 2")
    strata = df.groupBy("component_id", "category", "target").agg(F.count(F.lit(1)).alias("n"))
    per_component = strata.groupBy("component_id").agg(
        F.sum("n").alias("size"),
        # Most rows first, then the smaller category and label.
        F.min(F.struct((-F.col("n")).alias("n"), "category", "target")).alias("_top"),
    ).select("component_id", "size", "_top.category", "_top.target")
    ranked = ordinal(
        per_component.withColumn("_hash", seeded_hash(seed, "component_id", method=method)),
        ["category", "target"],
        [-F.col("size"), F.col("_hash"), F.col("component_id")],
        "_n",
    )
    # Start each stratum at its own fold, or the first fold would collect every largest one.
    start = seeded_hash(seed, "category", "target", method=method)
    at = F.pmod(F.col("_n") - 1, F.lit(2 * folds))
    snake = F.least(at, F.lit(2 * folds - 1) - at)
    dealt = ranked.select(
        "component_id",
        F.pmod(snake + F.pmod(start, F.lit(folds)), F.lit(folds)).cast("tinyint").alias(out),
    )
    return df.join(unbroadcast(dealt), "component_id").select(*df.columns, out)


def build_folds(
    pairs: DataFrame, items: DataFrame, folds: int = 5, seed: int = 2026, method: str = "md5"
) -> DataFrame:
    """Pairs with category, component and fold.

    Labels have to be 0 or 1, every item in one fold: both are checked, not assumed. A label
    outside fails the job, a component in two folds raises.
    """
    label = F.col("target")
    binary = F.when(label.isin(0, 1), label).otherwise(F.raise_error(F.lit("a label is neither 0 nor 1")))
    labelled = settle(component_ids(with_category(pairs.withColumn("target", binary), items)))
    folded = settle(
        component_folds(labelled, folds, seed, method=method).select(
            "id1", "id2", "target", "category", "component_id", "fold"
        )
    )
    enforce(component_leakage(folded), "fold_leaks")
    return folded
