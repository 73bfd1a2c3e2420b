"""Searching weights, methods and routes over out-of-fold scores.

A ranking reads its input several times (values, pivots, offsets), so a stage that feeds
one is settled unless it is a plain scan; otherwise every pass would redo it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmatch.operators import blending as B
from pairmatch.operators import routing as R
from pairmatch.operators.joins import with_category_parameters
from pairmatch.operators.metrics import cohort_precision
from pairmatch.session import publish, settle, shuffle_width

THRESHOLDS = ("hard_negative_min_similarity", "hard_positive_max_similarity")
REPRESENTATIONS = ("raw_logit", "category_rank")


def with_thresholds(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    return with_category_parameters(scored, thresholds, THRESHOLDS)


def long_features(df: DataFrame, models: Sequence[str]) -> DataFrame:
    """Rows per representation with feature columns ``f0, f1, ...`` (raw or fold rank)."""
    ranked = B.rank_features(df, models, ["category", "fold"])
    forms = F.array(
        *[
            F.struct(
                F.lit(form).alias("representation"),
                *[F.col(m + suffix).cast("double").alias(f"f{i}") for i, m in enumerate(models)],
            )
            for form, suffix in zip(REPRESENTATIONS, ("", "_rank"), strict=True)
        ]
    )
    return ranked.select(*df.columns, F.inline(forms))


def _subsets_of(
    candidates: Sequence[Sequence[float]], models: Sequence[str], sizes: Sequence[int]
) -> Column:
    """Names of the model subsets a candidate belongs to: zero weight outside of them."""
    subsets = {
        "+".join(models[i] for i in used): used
        for size in sizes
        for used in combinations(range(len(models)), size)
    }
    named = [
        [
            name
            for name, used in subsets.items()
            if all(w == 0.0 for at, w in enumerate(vector) if at not in used)
        ]
        for vector in candidates
    ]
    table = F.array(*[F.array(*[F.lit(n) for n in row]).cast("array<string>") for row in named])
    return F.element_at(table, F.col("candidate") + 1)


def search_weights(
    long: DataFrame,
    models: Sequence[str],
    folds: Sequence[int],
    step: float,
    subset_sizes: Sequence[int] = (2, 3),
) -> tuple[DataFrame, DataFrame]:
    """Cross-fitted and final weights of every method, from ``long_features``.

    A method is a model subset, a representation and a scope. Subset weights are the
    faces of the full simplex, so one grid per representation serves every subset.
    Returns ``variant, fold, category, weights`` (category null for global scope) and
    ``variant, category, weights`` for deployment.
    """
    candidates = B.simplex(len(models), step)
    features = [f"f{i}" for i in range(len(models))]
    grid = settle(B.weight_grid(long, features, candidates, folds, ["representation"]))
    spread = grid.withColumn("subset", F.explode(_subsets_of(candidates, models, subset_sizes)))
    keys = ["representation", "subset"]
    picked = {
        "global": B.best_candidates(
            B.macro_grid(spread, keys), [*keys, "cohort"], candidates
        ).withColumn("category", F.lit(None).cast("string")),
        "category": B.best_candidates(spread, [*keys, "cohort", "category"], candidates),
    }
    named = [
        table.select(
            F.concat_ws("__", "subset", "representation", F.lit(scope)).alias("variant"),
            "representation",
            "cohort",
            "category",
            "weights",
            "training_score",
        )
        for scope, table in picked.items()
    ]
    methods = settle(named[0].unionByName(named[1]))
    whole = F.col("cohort") == B.ALL
    fitted = methods.where(~whole).select(
        "variant",
        "representation",
        F.substring_index("cohort", "_", -1).cast("int").alias("fold"),
        "category",
        "weights",
        "training_score",
    )
    return fitted, methods.where(whole).drop("cohort", "representation")


def method_predictions(long: DataFrame, models: Sequence[str], weights: DataFrame) -> DataFrame:
    """Every row under every method: ``variant`` and its cross-fitted ``predict``."""
    features = [f"f{i}" for i in range(len(models))]
    kept = [c for c in long.columns if c not in (*features, "representation")]
    per_cell = weights.groupBy("representation", "fold", "category").agg(
        F.collect_list(F.struct("variant", "weights")).alias("_methods")
    )
    shared = per_cell.where("category is null").select(
        "representation", "fold", F.col("_methods").alias("_global")
    )
    own = per_cell.where("category is not null")
    empty = F.array().cast("array<struct<variant:string,weights:array<double>>>")
    # Each row is copied once per method: deal the rows evenly before that.
    even = long.repartition(shuffle_width(long.sparkSession))
    joined = even.join(shared, ["representation", "fold"], "left").join(
        own, ["representation", "fold", "category"], "left"
    )
    spread = joined.select(
        *kept,
        *features,
        F.inline(F.concat(F.coalesce("_global", empty), F.coalesce("_methods", empty))),
    )
    return spread.select(
        *kept, "variant", B.weighted_sum(F.col("weights"), features).alias("predict")
    )


def ensemble_search(
    scored: DataFrame,
    thresholds: DataFrame,
    models: Sequence[str],
    folds: Sequence[int],
    step: float = 0.05,
    gates: R.Gates = R.Gates(),
    subset_sizes: Sequence[int] = (2, 3),
) -> DataFrame:
    """Evidence and verdict per method, against the first model alone."""
    long = publish(long_features(scored, models))
    weights, _ = search_weights(long, models, folds, step, subset_sizes)
    methods = method_predictions(long, models, weights)
    base = scored.withColumn("variant", F.lit("base")).withColumn(
        "predict", F.col(models[0]).cast("double")
    )
    rows = with_thresholds(methods.unionByName(base), thresholds)
    report = cohort_precision(
        rows, ["variant", "category"], F.col("predict"), F.col("target"), R.report_cohorts(folds)
    )
    return R.promotion_gates(R.compare_variants(settle(report), "base"), gates)


def two_model_report(
    scored: DataFrame,
    thresholds: DataFrame,
    base: str,
    candidate: str,
    folds: Sequence[int],
    step: float = 0.05,
    gates: R.Gates = R.Gates(weight_range=0.25),
    correction: float = 0.0,
    margin: float = 0.02,
) -> DataFrame:
    """Global raw and rank blends of two models with evidence, verdict and forecast."""
    models = [base, candidate]
    long = publish(long_features(scored, models))
    weights, final = search_weights(long, models, folds, step, (2,))
    weights = weights.where("category is null")
    spread = weights.groupBy("variant").agg(
        (F.max(F.col("weights")[1]) - F.min(F.col("weights")[1])).alias("weight_range")
    )
    deployed = final.where("category is null").select(
        "variant", F.col("weights")[1].alias("final_weight")
    )
    methods = method_predictions(long, models, weights)
    reference = scored.withColumn("variant", F.lit("base")).withColumn(
        "predict", F.col(base).cast("double")
    )
    rows = with_thresholds(methods.unionByName(reference), thresholds)
    report = cohort_precision(
        rows, ["variant", "category"], F.col("predict"), F.col("target"), R.report_cohorts(folds)
    )
    verdicts = R.promotion_gates(
        R.compare_variants(settle(report), "base"), gates, spread.join(deployed, "variant")
    )
    point = F.col("score") - F.lit(correction)
    return verdicts.select(
        "*",
        point.alias("forecast"),
        (point - F.lit(margin)).alias("forecast_low"),
        (point + F.lit(margin)).alias("forecast_high"),
    )


def weighted_corrections(
    final: DataFrame, models: Sequence[str], corrections: Mapping[str, float]
) -> DataFrame:
    """Correction per method: weights times model corrections, mean over categories."""
    shift = F.lit(0.0)
    for i, model in enumerate(models):
        shift = shift + F.col("weights")[i] * F.lit(corrections[model])
    return final.groupBy("variant").agg(F.avg(shift).alias("correction"))


def router_report(
    scored: DataFrame,
    thresholds: DataFrame,
    folds: Sequence[int],
    base: str,
    candidate: Column,
    gates: R.Gates = R.Gates(),
) -> DataFrame:
    """Evidence and verdict for every top-K category router."""
    rows = publish(with_thresholds(scored, thresholds).withColumn("_blend", candidate))
    routed = R.top_k_routers(
        rows, folds, F.col(base), F.col("_blend"), R.report_cohorts(folds)
    ).withColumn("variant", F.concat(F.lit("top_"), F.lpad(F.col("k").cast("string"), 2, "0")))
    reference = R.variant_report(rows, {"base": F.col(base)}, R.report_cohorts(folds))
    report = routed.select(*reference.columns).unionByName(reference)
    return R.promotion_gates(R.compare_variants(settle(report), "base"), gates)


def category_route_report(
    scored: DataFrame,
    thresholds: DataFrame,
    folds: Sequence[int],
    base: str,
    candidate: str,
    minimum_uplift: float = 0.003,
    gates: R.Gates = R.Gates(),
    training_positive_folds: int = 3,
    deployment_positive_folds: int = 4,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cross-fitted route between two variants: cells, routed rows, comparison."""
    deltas = R.training_deltas(scored, folds, F.col(base), F.col(candidate))
    route = settle(
        R.select_route(
            deltas, minimum_uplift, training_positive_folds, deployment_positive_folds
        )
    )
    routed = settle(R.apply_route(scored, route, F.col(base), F.col(candidate)))
    rows = with_thresholds(routed, thresholds)
    report = R.variant_report(
        rows, {"base": F.col(base), "routed": F.col("predict")}, R.report_cohorts(folds)
    )
    return route, routed, R.promotion_gates(R.compare_variants(report, "base"), gates)


def residual_report(
    scored: DataFrame,
    thresholds: DataFrame,
    folds: Sequence[int],
    reference: str,
    residual: str,
    categories: Sequence[str],
    reference_weight: float,
    model_weight: float,
    gates: R.Gates = R.Gates(0.0, 4, None, None, 0.0),
) -> DataFrame:
    """A fixed residual with fold-local ranks, against its reference."""
    mixed = settle(
        B.rank_residual(
            scored, reference, residual, categories, reference_weight, model_weight,
            keys=("category", "fold"),
        )
    )
    rows = with_thresholds(mixed, thresholds)
    report = R.variant_report(
        rows, {"base": F.col(reference), "residual": F.col("predict")}, R.report_cohorts(folds)
    )
    return R.promotion_gates(R.compare_variants(report, "base"), gates)
