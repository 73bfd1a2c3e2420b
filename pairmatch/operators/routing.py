"""Comparing score variants: reports, gates, category routers and parity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairmatch.operators.blending import blend_scores, rank_residual
from pairmatch.operators.joins import validated_scores
from pairmatch.operators.metrics import (
    STRESS,
    average_precision,
    cell_precision,
    cohort_cells,
    cohort_precision,
    macro,
    spearman,
    stress_cohorts,
)
from pairmatch.session import publish, settle
from pairmatch.sources.tables import PAIR_KEYS

ALL = "all"
# Sums of the same numbers in another order differ in the last digits; a difference below
# this many decimals is none.
DELTA_DIGITS = 12


@dataclass(frozen=True)
class Gates:
    """Promotion thresholds; None switches a gate off."""

    minimum_uplift: float = 0.002
    positive_folds: int = 4
    nonnegative_categories: int | None = 16
    worst_category_delta: float | None = -0.005
    worst_stress_delta: float | None = 0.0
    weight_range: float | None = None


@dataclass(frozen=True)
class Residual:
    """One more component, mixed in by category rank inside the routed categories."""

    component: str
    categories: tuple[str, ...]
    reference_weight: float
    model_weight: float


def report_cohorts(folds: Sequence[int], stress: bool = True) -> dict[str, Column]:
    """Everything, each fold, each stress slice."""
    cohorts = {ALL: F.lit(True)}
    for fold in folds:
        cohorts[f"fold_{fold}"] = F.col("fold") == fold
    if stress:
        cohorts.update(stress_cohorts())
    return cohorts


def variant_report(
    df: DataFrame, variants: Mapping[str, Column], cohorts: Mapping[str, Column]
) -> DataFrame:
    """Average precision per ``variant, category, cohort`` for several score columns.

    Variants are stacked as rows, so all of them share one ranking job.
    """
    needed = [
        c
        for c in (
            "category", "fold", "target", "surface_similarity", "identity_conflicts",
            "hard_negative_min_similarity", "hard_positive_max_similarity",
        )
        if c in df.columns
    ]
    rows = df.select(*needed, *[s.alias(f"_s{i}") for i, s in enumerate(variants.values())])
    stacked = F.inline(
        F.array(
            *[
                F.struct(F.lit(name).alias("variant"), F.col(f"_s{i}").cast("double").alias("_score_in"))
                for i, name in enumerate(variants)
            ]
        )
    )
    return cohort_precision(
        rows.select(*needed, stacked),
        ["variant", "category"],
        F.col("_score_in"),
        F.col("target"),
        cohorts,
    )


def _difference(left: Column, right: Column) -> Column:
    return F.round(left - right, DELTA_DIGITS)


def compare_variants(report: DataFrame, base: str) -> DataFrame:
    """Per category and cohort: every variant next to the base, and the difference."""
    reference = report.where(F.col("variant") == base).select(
        "category", "cohort", F.col("average_precision").alias("reference")
    )
    return (
        report.where(F.col("variant") != base)
        .join(reference, ["category", "cohort"])
        .select(
            "variant", "category", "cohort", "rows",
            F.col("average_precision").alias("candidate"),
            "reference",
            _difference(F.col("average_precision"), F.col("reference")).alias("delta"),
        )
    )


def cohort_means(compared: DataFrame, keys: Sequence[str] = ("variant",)) -> DataFrame:
    """Macro scores and their difference per cohort."""
    return compared.groupBy(*keys, "cohort").agg(
        F.avg("candidate").alias("candidate"),
        F.avg("reference").alias("reference"),
        _difference(F.avg("candidate"), F.avg("reference")).alias("delta"),
    )


def promotion_gates(
    compared: DataFrame,
    gates: Gates = Gates(),
    weights: DataFrame | None = None,
    keys: Sequence[str] = ("variant",),
) -> DataFrame:
    """One row per variant: uplift, fold, category and stress evidence and the verdict.

    ``weights`` may add ``weight_range`` and ``final_weight`` per variant.
    """
    means = cohort_means(compared, keys)
    folds = F.col("cohort").startswith("fold_")
    stressed = F.col("cohort").isin(*STRESS)
    overall = means.groupBy(*keys).agg(
        F.max(F.when(F.col("cohort") == ALL, F.col("candidate"))).alias("score"),
        F.max(F.when(F.col("cohort") == ALL, F.col("delta"))).alias("uplift"),
        F.count_if(folds & (F.col("delta") > 0)).alias("positive_folds"),
        F.min(F.when(stressed, F.col("delta"))).alias("worst_stress_delta"),
    )
    whole = compared.where(F.col("cohort") == ALL)
    per_category = whole.groupBy(*keys).agg(
        F.count_if(F.col("delta") >= 0).alias("nonnegative_categories"),
        F.count_if(F.col("delta") > 0).alias("positive_categories"),
        F.min("delta").alias("worst_category_delta"),
    )
    table = overall.join(per_category, list(keys))
    passed = (F.col("uplift") >= gates.minimum_uplift) & (
        F.col("positive_folds") >= gates.positive_folds
    )
    if gates.nonnegative_categories is not None:
        passed = passed & (F.col("nonnegative_categories") >= gates.nonnegative_categories)
    if gates.worst_category_delta is not None:
        passed = passed & (F.col("worst_category_delta") >= gates.worst_category_delta)
    if gates.worst_stress_delta is not None:
        passed = passed & (F.col("worst_stress_delta") >= gates.worst_stress_delta)
    if weights is not None:
        table = table.join(weights, list(keys))
        passed = passed & (F.col("final_weight") > 0)
        if gates.weight_range is not None:
            passed = passed & (F.col("weight_range") <= gates.weight_range)
    return table.withColumn("passed", F.coalesce(passed, F.lit(False)))


def ranking(verdicts: DataFrame, name: str = "variant") -> DataFrame:
    """Position of each method by score, and the best one that passed."""
    order = Window.orderBy(F.desc("score"), F.asc(name))
    best = verdicts.where("passed").agg(F.max_by(name, F.col("score")).alias("winner"))
    return verdicts.select(
        name,
        "score",
        "passed",
        F.row_number().over(order).alias("position"),
        F.col(name).eqNullSafe(best.scalar()).alias("winner"),
    )


# -- category routers ----------------------------------------------------------------


def training_deltas(
    df: DataFrame, folds: Sequence[int], base: Column, candidate: Column
) -> DataFrame:
    """Category uplift of the candidate for every training cohort.

    ``validation_fold`` f means all folds but f; null means all folds. ``positive_folds``
    counts the cohort's folds whose own uplift is positive.
    """
    cohorts: dict[str, Column] = {ALL: F.lit(True)}
    for fold in folds:
        cohorts[f"fold_{fold}"] = F.col("fold") == fold
        cohorts[f"except_{fold}"] = F.col("fold") != fold
    report = variant_report(df, {"base": base, "candidate": candidate}, cohorts)
    compared = compare_variants(report, "base")
    per_category = compared.groupBy("category").agg(
        F.map_from_entries(F.collect_list(F.struct("cohort", "delta"))).alias("_delta")
    )
    def entry(validation: int | None) -> Column:
        training = [f for f in folds if f != validation]
        positive = sum(
            [
                F.when(F.try_element_at("_delta", F.lit(f"fold_{f}")) > 0, 1).otherwise(0)
                for f in training
            ],
            F.lit(0),
        )
        name = ALL if validation is None else f"except_{validation}"
        return F.struct(
            F.lit(validation).cast("int").alias("validation_fold"),
            F.try_element_at("_delta", F.lit(name)).alias("delta"),
            positive.alias("positive_folds"),
        )

    return per_category.select(
        "category", F.inline(F.array(*[entry(f) for f in [None, *folds]]))
    )


def top_categories(deltas: DataFrame) -> DataFrame:
    """Rank categories by uplift inside each training cohort, ties by name."""
    order = Window.partitionBy("validation_fold").orderBy(F.desc("delta"), F.asc("category"))
    return deltas.withColumn("position", F.row_number().over(order))


def top_k_routers(
    df: DataFrame,
    folds: Sequence[int],
    base: Column,
    candidate: Column,
    cohorts: Mapping[str, Column],
) -> DataFrame:
    """Metrics of every top-K category router, cross-fitted, for all K at once.

    With growing K a category's folds switch to the candidate one after another, so a
    category has at most ``folds + 1`` distinct score columns whatever the number of
    routers. Each row is scored once per such state, and a router of size K picks the
    state its rank cut implies. Returns ``k, category, cohort, rows, average_precision``.
    """
    ranked = top_categories(training_deltas(df, folds, base, candidate)).where(
        "validation_fold is not null"
    )
    by_fold = Window.partitionBy("category").orderBy("position", "validation_fold")
    # One row per category and fold, read by three branches below.
    switch = settle(
        ranked.select(
            "category",
            F.col("validation_fold").alias("fold"),
            "position",
            F.row_number().over(by_fold).alias("switch"),
        )
    )
    states = F.sequence(F.lit(0), F.lit(len(folds)))
    named = df.withColumn("_base", base).withColumn("_candidate", candidate)
    cells = cohort_cells(named, ["category", "fold"], ["_base", "_candidate"], F.col("target"), cohorts)
    spread = cells.join(switch.select("category", "fold", "switch"), ["category", "fold"]).select(
        "*", F.explode(states).alias("state")
    )
    score = F.when(F.col("switch") <= F.col("state"), F.col("_candidate")).otherwise(F.col("_base"))
    per_state = cell_precision(spread.withColumn("_score", score), ["category", "state"], cohorts)
    sizes = switch.groupBy("category").agg(F.collect_list("position").alias("_positions")).select(
        "category",
        "_positions",
        F.explode(F.sequence(F.lit(1), switch.agg(F.max("position")).scalar())).alias("k"),
    )
    chosen = sizes.select(
        "category",
        "k",
        F.size(F.filter("_positions", lambda p: p <= F.col("k"))).alias("state"),
    )
    return per_state.join(chosen, ["category", "state"]).select(
        "k", "category", "cohort", "rows", "positives", "average_precision"
    )


def select_route(
    deltas: DataFrame,
    minimum_uplift: float = 0.003,
    training_positive_folds: int = 3,
    deployment_positive_folds: int = 4,
) -> DataFrame:
    """(validation_fold, category) cells that earned the candidate; null fold deploys."""
    if minimum_uplift <= 0.0:
        raise ValueError("the minimum uplift must be positive")
    needed = F.when(F.col("validation_fold").isNull(), deployment_positive_folds).otherwise(
        training_positive_folds
    )
    return deltas.where(
        (F.col("delta") >= minimum_uplift) & (F.col("positive_folds") >= needed)
    ).select("validation_fold", "category")


def apply_route(
    df: DataFrame, route: DataFrame, base: Column, candidate: Column, out: str = "predict"
) -> DataFrame:
    """Candidate score on routed (fold, category) cells, the untouched base elsewhere."""
    cells = route.where("validation_fold is not null").select(
        F.col("validation_fold").alias("fold"), "category", F.lit(True).alias("_on")
    )
    routed = F.coalesce("_on", F.lit(False))
    named = df.withColumn("_base", base).withColumn("_candidate", candidate)
    return named.join(cells, ["fold", "category"], "left").select(
        *df.columns,
        F.when(routed, F.col("_candidate")).otherwise(F.col("_base")).alias(out),
        routed.alias("routed"),
    )


def paired_arms(report: DataFrame, arms: Sequence[str]) -> DataFrame:
    """Two arms side by side per category and cohort, with their difference."""
    first, second = arms
    return (
        report.groupBy("category", "cohort")
        .pivot("variant", list(arms))
        .agg(F.first("average_precision"))
        .withColumn("delta", _difference(F.col(second), F.col(first)))
    )


def parity(
    df: DataFrame,
    actual: str,
    expected: str,
    max_delta: float = 0.125,
    max_mean_delta: float = 0.01,
    min_spearman: float = 0.9999,
) -> DataFrame:
    """How closely shipped scores follow the recomputed ones, and the verdict."""
    delta = F.abs(F.col(actual) - F.col(expected))
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.max(delta).alias("max_abs_delta"),
        F.avg(delta).alias("mean_abs_delta"),
    )
    overall = spearman(df.withColumn("_one", F.lit(1)), ["_one"], actual, expected)
    by_category = spearman(df, ["category"], actual, expected)
    return (
        row.select(
            "*",
            overall.select("spearman").scalar().alias("global_spearman"),
            by_category.agg(F.min("spearman")).scalar().alias("minimum_category_spearman"),
        )
        .withColumn(
            "passed",
            (F.col("max_abs_delta") <= max_delta)
            & (F.col("mean_abs_delta") <= max_mean_delta)
            & (F.col("minimum_category_spearman") >= min_spearman),
        )
    )


def check_record(rebuilt: DataFrame, records: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """``record, metric, rebuilt, matches``: recorded metrics against the one rebuilt from scores.

    ``rebuilt(target, category, predict)`` has one row per pair, ``records(record, metric)``
    come from elsewhere; a null or NaN metric matches nothing.
    """
    found = macro(average_precision(rebuilt, ["category"], "predict")).select("macro_average_precision")
    compared = records.select("record", "metric", found.scalar().alias("rebuilt"))
    near = F.abs(F.col("metric") - F.col("rebuilt")) <= tolerance
    return compared.withColumn("matches", F.coalesce(near, F.lit(False)) & ~F.isnan("metric"))


def shipped_parity(
    shipped: DataFrame,
    base: DataFrame,
    components: Mapping[str, DataFrame],
    weights: Sequence[float] | DataFrame,
    residual: Residual | None = None,
    **limits: float,
) -> DataFrame:
    """A shipped table against the blend recomputed from its components: differences and verdict.

    ``base(id1, id2, category)`` names the pairs; ``shipped`` and every component hold
    exactly those, once each, with finite scores in ``predict``, or the job fails. With
    ``residual`` the routed categories mix ranks of the blend and of one more component.
    """
    tables = {"_shipped": shipped, **components}
    joined = publish(validated_scores(base.select(*PAIR_KEYS, "category"), tables, same=()))
    blended = blend_scores(joined, [c for c in components if residual is None or c != residual.component], weights, out="_blend")
    expected = blended.withColumn("_expected", F.col("_blend"))
    if residual is not None:
        expected = rank_residual(
            publish(blended), "_blend", residual.component, residual.categories,
            residual.reference_weight, residual.model_weight, "_expected",
        )
    return parity(publish(expected), "_shipped", "_expected", **limits)


def output_order(df: DataFrame) -> list[Column]:
    """The order of a finished table, as the columns that an ordered sink deals it by."""
    return [F.col(c) for c in (*(["fold"] if "fold" in df.columns else []), *PAIR_KEYS)]
