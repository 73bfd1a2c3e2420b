"""Descriptive aggregates of pair, fold and candidate tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmatch.functions.numeric import finite, majority_positive
from pairmatch.operators.ranking import quantiles
from pairmatch.sources.tables import PAIR_KEYS



def dataset_summary(joined: DataFrame, similarity: str | None = "surface_similarity") -> DataFrame:
    """Size, distinct items, label and similarity statistics of a joined pair table."""
    target = F.col("target")
    required = (
        F.col("category").isNull() | F.col("left_name").isNull() | F.col("right_name").isNull()
    )
    columns: list[Column] = [
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("id1").alias("unique_left_items"),
        F.count_distinct("id2").alias("unique_right_items"),
        F.avg(target).alias("mean_target"),
        F.count_if(majority_positive(target)).alias("majority_positive_rows"),
        F.count_if(required).alias("required_null_rows"),
        F.count_if(~F.col("category").eqNullSafe(F.col("right_category"))).alias(
            "category_mismatch_rows"
        ),
    ]
    if similarity:
        value = F.col(similarity)
        columns += [
            F.min(value).cast("double").alias("min_surface_similarity"),
            F.avg(value).alias("mean_surface_similarity"),
            F.max(value).cast("double").alias("max_surface_similarity"),
            F.count_if(~(finite(value) & value.between(0.0, 1.0))).alias(
                "invalid_surface_similarity_rows"
            ),
        ]
    return joined.agg(*columns)


def category_summary(joined: DataFrame) -> DataFrame:
    return joined.groupBy("category").agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg("target").alias("mean_target"),
        F.count_if(majority_positive(F.col("target"))).alias("majority_positive_rows"),
    )


def fold_summary(df: DataFrame, fold: str = "fold") -> DataFrame:
    """Rows, positives, rate and components per (fold, category) and per fold.

    One aggregation with grouping sets; the per-fold rows have a null category.
    """
    grouped = df.groupingSets(
        [[F.col(fold), F.col("category")], [F.col(fold)]], F.col(fold), F.col("category")
    )
    return grouped.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("target").cast("bigint").alias("positives"),
        F.avg("target").alias("positive_rate"),
        F.count_distinct("component_id").alias("components"),
    )


def category_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("category").agg(F.count(F.lit(1)).alias("rows"))


def inverse_category_weights(counts: DataFrame) -> DataFrame:
    """``total / (categories * rows)``: every category weighs the same in total."""
    totals = counts.agg(F.sum("rows").alias("total"), F.count(F.lit(1)).alias("categories"))
    return counts.select(
        "category",
        "rows",
        (
            totals.select("total").scalar()
            / (totals.select("categories").scalar() * F.col("rows"))
        ).alias("weight"),
    )


def hard_pair_thresholds(
    df: DataFrame,
    negative_target_max: float = 0.2,
    positive_target_min: float = 0.8,
    negative_quantile: float = 0.75,
    positive_quantile: float = 0.25,
    similarity: str = "surface_similarity",
) -> DataFrame:
    """Exact similarity quantiles of confident negatives and positives per category.

    Rows without a similarity are counted as candidates and have no part in the quantiles; a
    category without candidates of a kind has a null threshold.
    """
    if not 0.0 <= negative_target_max < positive_target_min <= 1.0:
        raise ValueError("need 0 <= negative_target_max < positive_target_min <= 1")
    if not (0.0 < negative_quantile < 1.0 and 0.0 < positive_quantile < 1.0):
        raise ValueError("quantiles must be inside (0, 1)")
    negative = F.col("target") <= negative_target_max
    positive = F.col("target") >= positive_target_min
    return quantiles(
        df.withColumn("_similarity", F.col(similarity).cast("double")),
        ["category"],
        "_similarity",
        {
            "hard_negative_min_similarity": (negative, negative_quantile),
            "hard_positive_max_similarity": (positive, positive_quantile),
        },
        {"hard_negative_min_similarity": "negative_candidates", "hard_positive_max_similarity": "positive_candidates"},
    )


def grouped_means(df: DataFrame, keys: Sequence[str], means: Sequence[str]) -> DataFrame:
    """Rows and the named means per group (strata, reasons, replay categories)."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), *[F.avg(m).alias(f"mean_{m}") for m in means]
    )


def rollup_audit(df: DataFrame, target: str = "target") -> DataFrame:
    """Rows, distinct pairs and categories, and the label range."""
    per_pair = df.groupBy(*PAIR_KEYS).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(target).alias("low"),
        F.max(target).alias("high"),
    )
    pairs = per_pair.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("unique_pairs"),
        F.min("low").alias("target_min"),
        F.max("high").alias("target_max"),
    )
    categories = df.agg(F.count_distinct("category").alias("categories"))
    return pairs.select("*", categories.scalar().alias("categories"))


def item_ids(pairs: DataFrame) -> DataFrame:
    """Distinct items of an edge table, in one scan."""
    return pairs.select(F.explode(F.array(*PAIR_KEYS)).alias("id")).distinct()


def item_overlap(first: DataFrame, second: DataFrame) -> DataFrame:
    """Distinct items of two pair tables and how many they share."""
    def ends(df: DataFrame, flag: int) -> DataFrame:
        return df.select(F.explode(F.array(*PAIR_KEYS)).alias("id"), F.lit(flag).alias("_side"))

    sides = ends(first, 1).unionByName(ends(second, 2)).groupBy("id").agg(
        F.bit_or("_side").alias("_side")
    )
    return sides.agg(
        F.count_if(F.col("_side").bitwiseAND(1) > 0).alias("first_items"),
        F.count_if(F.col("_side").bitwiseAND(2) > 0).alias("second_items"),
        F.count_if(F.col("_side") == 3).alias("shared_items"),
    )


def nested_fold_overlap(df: DataFrame, folds: Sequence[int], inner_validation: int) -> DataFrame:
    """Item overlaps of outer validation, inner validation and inner training.

    Every item gets one bit per role and outer fold, so the pairwise intersections are
    counts over a single aggregation instead of a join per pair of sets.
    """
    roles = [
        F.when(F.col("fold") == f, F.lit(1))
        .when(F.col("inner_fold") == inner_validation, F.lit(2))
        .otherwise(F.lit(4))
        .alias(f"_r{f}")
        for f in folds
    ]
    ends = df.select(F.explode(F.array(*PAIR_KEYS)).alias("id"), *roles)
    bits = ends.groupBy("id").agg(*[F.bit_or(f"_r{f}").alias(f"_r{f}") for f in folds])
    long = bits.select(
        F.inline(
            F.array(
                *[F.struct(F.lit(f).alias("outer_fold"), F.col(f"_r{f}").alias("_b")) for f in folds]
            )
        )
    )

    def having(mask: int) -> Column:
        return F.count_if(F.col("_b").bitwiseAND(mask) == mask)

    return long.groupBy("outer_fold").agg(
        having(1).alias("outer_validation_items"),
        having(2).alias("inner_validation_items"),
        having(4).alias("inner_training_items"),
        having(6).alias("inner_train_validation_overlap"),
        having(5).alias("inner_train_outer_overlap"),
        having(3).alias("inner_validation_outer_overlap"),
    )


def tidy(metrics: DataFrame, dataset: str) -> DataFrame:
    """One-row table to ``dataset, metric, value`` rows."""
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
            for c in metrics.columns
        ]
    )
    return metrics.select(F.lit(dataset).alias("dataset"), F.inline(rows))


def stack(tables: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)
