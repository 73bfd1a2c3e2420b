"""Score blending, weight search and cross-fitted weights."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmatch.operators.metrics import cell_precision, cohort_cells
from pairmatch.operators.ranking import percentile_ranks, with_required

# Two scores closer than this count as a tie in the weight search.
IMPROVEMENT = 1e-12
TIE_RELATIVE = 1e-5

ALL = "all"


def simplex(models: int, step: float) -> list[tuple[float, ...]]:
    """Non-negative weight vectors that sum to one, in ascending order."""
    units = round(1.0 / step) if 0.0 < step <= 1.0 else 0
    if models < 2 or not units or not math.isclose(units * step, 1.0):
        raise ValueError("need two models or more and a step that divides one")

    def spread(left: int, slots: int):
        if slots == 1:
            yield (left,)
            return
        for first in range(left + 1):
            for rest in spread(left - first, slots - 1):
                yield (first, *rest)

    return [tuple(u / units for u in vector) for vector in spread(units, models)]


def check_weights(weights: Sequence[float], models: int) -> None:
    if (
        len(weights) != models
        or any(not math.isfinite(w) or w < 0.0 for w in weights)
        or not math.isclose(sum(weights), 1.0, rel_tol=1e-5, abs_tol=1e-8)
    ):
        raise ValueError("weights must be finite, non-negative and sum to one")


def weighted_sum(weights: Column, features: Sequence[str], first: int = 0) -> Column:
    """Dot product of a weight array with the feature columns, left to right."""
    total = weights[first] * F.col(features[0])
    for i, feature in enumerate(features[1:], start=first + 1):
        total = total + weights[i] * F.col(feature)
    return total


def weight_table(df: DataFrame, weights: DataFrame, models: int) -> DataFrame:
    """Attach ``weights`` by category; a category without a vector fails the job."""
    valid = (
        (F.size("weights") == models)
        & F.forall("weights", lambda w: (w >= 0) & ~F.isnan(w) & (w < float("inf")))
        & (F.abs(F.aggregate("weights", F.lit(0.0), lambda a, w: a + w) - 1.0) <= 1e-5)
    )
    message = F.concat(F.lit("no valid ensemble weights for category "), F.col("category"))
    checked = F.when(F.coalesce(valid, F.lit(False)), F.col("weights")).otherwise(
        F.raise_error(message).cast("array<double>")
    )
    return df.join(weights.select("category", "weights"), "category", "left").select(
        *df.columns, checked.alias("weights")
    )


def rank_features(
    df: DataFrame, scores: Sequence[str], keys: Sequence[str], suffix: str = "_rank"
) -> DataFrame:
    """Percentile rank of every score column inside ``keys``."""
    return percentile_ranks(df, keys, {score: f"{score}{suffix}" for score in scores})


def blend_scores(
    df: DataFrame,
    scores: Sequence[str],
    weights: Sequence[float] | DataFrame,
    representation: str = "raw_logit",
    out: str = "predict",
) -> DataFrame:
    """Weighted sum of raw scores or of category percentile ranks.

    ``weights`` is one vector for all rows, or a table ``category, weights``. A null or NaN
    score fails the job in either form.
    """
    if len(scores) < 2:
        raise ValueError("a blend needs two score columns or more")
    if representation == "category_rank":
        source, features = rank_features(df, scores, ["category"]), [f"{s}_rank" for s in scores]
    elif representation == "raw_logit":
        # A missing score would be a missing prediction; ranks refuse it too.
        source, features = with_required(df, [], list(scores)), list(scores)
    else:
        raise ValueError(f"unsupported representation: {representation}")
    if isinstance(weights, DataFrame):
        source = weight_table(source, weights, len(scores))
        vector = F.col("weights")
    else:
        check_weights(weights, len(scores))
        vector = F.array(*[F.lit(float(w)) for w in weights])
    return source.select(*df.columns, weighted_sum(vector, features).alias(out))


def active_rows(df: DataFrame, weights: Sequence[float] | DataFrame, model: int) -> DataFrame:
    """Rows whose blend uses the model at all, so that the others are never scored."""
    if not isinstance(weights, DataFrame):
        return df if weights[model] > 0.0 else df.where(F.lit(False))
    used = weights.where(F.col("weights")[model] > 0).select("category")
    return df.join(used, "category", "left_semi").select(*df.columns)


def with_length_route(
    df: DataFrame, routes: DataFrame | None, default: int, out: str = "max_length"
) -> DataFrame:
    """Maximum text length per row: the category's own, or the default."""
    if routes is None:
        return df.withColumn(out, F.lit(default))
    return df.join(
        routes.select("category", F.col("max_length").alias("_routed")), "category", "left"
    ).select(*df.columns, F.coalesce("_routed", F.lit(default)).alias(out))


def rank_residual(
    df: DataFrame,
    reference: str,
    residual: str,
    categories: Sequence[str],
    reference_weight: float,
    model_weight: float,
    out: str = "predict",
    keys: Sequence[str] = ("category",),
) -> DataFrame:
    """Blend category ranks inside the routed categories, keep every other row as is.

    Only routed rows are ranked: ranks never look across categories.
    """
    check_weights((reference_weight, model_weight), 2)
    routed = F.col("category").isin(list(categories))
    inside = rank_features(df.where(routed), [reference, residual], keys)
    mixed = F.lit(reference_weight) * F.col(f"{reference}_rank") + F.lit(model_weight) * F.col(
        f"{residual}_rank"
    )
    kept = df.where(~routed).withColumn(out, F.col(reference).cast("double"))
    return inside.select(*df.columns, mixed.alias(out)).unionByName(kept)


def fold_cohorts(folds: Sequence[int]) -> dict[str, Column]:
    """All evaluation rows, and for each fold everything but it."""
    selected = F.col("fold").isin(list(folds))
    cohorts = {ALL: selected}
    for fold in folds:
        cohorts[f"except_{fold}"] = selected & (F.col("fold") != fold)
    return cohorts


def weight_grid(
    df: DataFrame,
    features: Sequence[str],
    candidates: Sequence[Sequence[float]],
    folds: Sequence[int],
    keys: Sequence[str] = (),
) -> DataFrame:
    """Average precision per ``keys, category, candidate, cohort``.

    Rows with equal features and cohorts are one cell. Cells are copied once per candidate and
    never per cohort: the training cohorts of all folds come out of one ranking per candidate.
    Scores are not rounded.
    """
    if len(set(folds)) < 2:
        raise ValueError("cross-fitting needs two folds or more")
    vectors = F.array(
        *[
            F.struct(F.lit(i).alias("candidate"), F.array(*[F.lit(float(w)) for w in v]).alias("w"))
            for i, v in enumerate(candidates)
        ]
    )
    cohorts = fold_cohorts(folds)
    cells = cohort_cells(df, [*keys, "category"], features, F.col("target"), cohorts)
    spread = cells.select("*", F.inline(vectors))
    return cell_precision(
        spread.withColumn("_score", weighted_sum(F.col("w"), features)),
        [*keys, "category", "candidate"],
        cohorts,
    )


def macro_grid(grid: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean over categories per candidate and cohort."""
    return grid.groupBy(*keys, "cohort", "candidate").agg(
        F.avg("average_precision").alias("average_precision"), F.sum("rows").alias("rows")
    )


def best_candidates(
    grid: DataFrame,
    keys: Sequence[str],
    candidates: Sequence[Sequence[float]],
    allowed: Column | None = None,
) -> DataFrame:
    """Winning candidate per key, with the tie rule that prefers later vectors.

    Candidates are visited in ascending order. One that beats the best score replaces it;
    one that merely ties takes its place without moving the score to beat, so the weights
    drift towards the first model. Each group folds over at most ``len(candidates)``
    entries.
    """
    rows = grid if allowed is None else grid.where(allowed)
    visited = F.array_sort(
        F.collect_list(
            F.struct("candidate", F.col("average_precision").alias("score"), F.col("rows"))
        )
    )
    start = F.struct(
        F.lit(-1).alias("candidate"),
        F.lit(float("-inf")).alias("score"),
        F.lit(0).cast("bigint").alias("rows"),
    )

    def visit(best: Column, entry: Column) -> Column:
        tie = F.abs(entry.score - best.score) <= IMPROVEMENT + TIE_RELATIVE * F.abs(best.score)
        return F.when(entry.score > best.score + IMPROVEMENT, entry).when(
            (best.candidate >= 0) & tie,
            F.struct(
                entry.candidate.alias("candidate"),
                best.score.alias("score"),
                entry.rows.alias("rows"),
            ),
        ).otherwise(best)

    vectors = F.array(*[F.array(*[F.lit(float(w)) for w in v]) for v in candidates])
    return (
        rows.groupBy(*keys)
        .agg(visited.alias("_visited"))
        .select(*keys, F.aggregate("_visited", start, visit).alias("_best"))
        .select(
            *keys,
            F.element_at(vectors, F.col("_best.candidate") + 1).alias("weights"),
            F.col("_best.score").alias("training_score"),
            F.col("_best.rows").alias("training_rows"),
        )
    )


def by_validation_fold(picked: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``except_<f>`` winners as the weights of validation fold f."""
    return picked.where(F.col("cohort").startswith("except_")).select(
        *keys,
        F.substring_index("cohort", "_", -1).cast("int").alias("fold"),
        "weights",
        "training_score",
        "training_rows",
    )


def cross_fitted_weights(
    grid: DataFrame, candidates: Sequence[Sequence[float]], scope: str
) -> DataFrame:
    """Weights per validation fold (``global``) or per fold and category (``category``)."""
    if scope == "global":
        return by_validation_fold(best_candidates(macro_grid(grid), ["cohort"], candidates))
    if scope == "category":
        picked = best_candidates(grid, ["cohort", "category"], candidates)
        return by_validation_fold(picked, ["category"])
    raise ValueError(f"unsupported scope: {scope}")


def final_weights(
    grid: DataFrame, candidates: Sequence[Sequence[float]], scope: str
) -> DataFrame:
    """Deployment weights fitted on every evaluation row."""
    everything = grid.where(F.col("cohort") == ALL)
    if scope == "global":
        return best_candidates(macro_grid(everything), ["cohort"], candidates).drop("cohort")
    if scope == "category":
        return best_candidates(everything, ["category"], candidates)
    raise ValueError(f"unsupported scope: {scope}")


def cross_fitted_predictions(
    df: DataFrame, features: Sequence[str], weights: DataFrame, out: str = "predict"
) -> DataFrame:
    """Score every row with the weights its own fold had no part in."""
    keys = [c for c in ("fold", "category") if c in weights.columns]
    joined = df.join(weights.select(*keys, "weights"), keys)
    return joined.select(*df.columns, weighted_sum(F.col("weights"), features).alias(out))
