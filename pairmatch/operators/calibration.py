"""Teacher scores: shards, Platt fits, calibration choice and application."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmatch.functions.numeric import finite, logistic
from pairmatch.operators.metrics import probability_report
from pairmatch.session import settle

VARIANTS = ("raw", "global_platt", "category_platt")


def combine_directions(df: DataFrame) -> DataFrame:
    """Mean of the forward and backward logits and its probability."""
    logit = (F.col("teacher_logit_forward") + F.col("teacher_logit_backward")) * 0.5
    return df.withColumn("teacher_logit", logit).withColumn(
        "teacher_probability", logistic(F.col("teacher_logit"))
    )


def platt_fit(
    df: DataFrame,
    keys: Sequence[str] = (),
    logit: str = "teacher_logit",
    target: str = "target",
    minimum_class_rows: int = 0,
    regularisation: float = 1.0,
    rounds: int = 60,
) -> DataFrame:
    """Logistic slope and intercept per group by Newton steps, all groups together.

    Minimises ``slope^2 / 2 + regularisation * sum(log loss)``. Equal (group, logit, label)
    rows are merged once. The groups' points are a table: a round joins it to the cells, adds
    up one row per group and moves the points; converged groups leave the rounds, and nothing
    per group reaches the driver. A step that raises the objective is halved. Groups short of
    either class are left out; one that has not converged after ``rounds``, or ends at a
    non-finite point, fails.
    """
    one = "_whole"
    names = list(keys) or [one]
    source = df if keys else df.withColumn(one, F.lit(0))
    cells = settle(
        source.groupBy(*names, F.col(logit).cast("double").alias("_x")).agg(
            F.count_if(F.col(target) == 1).cast("double").alias("_pos"),
            F.count_if(F.col(target) == 0).cast("double").alias("_neg"),
        )
    )
    needed = max(1, minimum_class_rows)
    sizes = cells.groupBy(*names).agg(F.sum("_pos").alias("p"), F.sum("_neg").alias("n"))
    none = F.lit(None).cast("double")
    zero = F.lit(0.0)
    state = settle(
        sizes.where((F.col("p") >= needed) & (F.col("n") >= needed)).select(
            *names,
            *[zero.alias(c) for c in ("_w", "_b")],
            *[none.alias(c) for c in ("_best_w", "_best_b", "_best")],
            F.lit(False).alias("_done"),
        )
    )
    for _ in range(rounds):
        live = state.where(~F.col("_done"))
        if live.isEmpty():
            break
        moved = _newton_step(live, cells, names, regularisation)
        state = settle(state.where("_done").unionByName(moved))
    open_groups = state.where(~F.col("_done")).count()
    if open_groups:
        raise RuntimeError(f"{open_groups} calibrations did not converge in {rounds} rounds")
    fitted = state.select(
        *keys,
        F.coalesce("_best_w", "_w").alias("coefficient"),
        F.coalesce("_best_b", "_b").alias("intercept"),
    )
    if not fitted.where(~(finite(F.col("coefficient")) & finite(F.col("intercept")))).isEmpty():
        raise RuntimeError("calibration produced a non-finite parameter")
    return fitted


def _newton_step(live: DataFrame, cells: DataFrame, names: Sequence[str], c: float) -> DataFrame:
    """The state of the live groups after one step from ``_w, _b``, the best point seen beside it."""
    rows = cells.join(live.select(*names, "_w", "_b"), list(names))
    z = F.col("_w") * F.col("_x") + F.col("_b")
    p = 1.0 / (1.0 + F.exp(-z))
    weight = F.col("_pos") + F.col("_neg")
    # log(1 + e^-z) and log(1 + e^z) without overflow.
    low = F.log1p(F.exp(-F.abs(z)))
    loss = F.col("_pos") * (low + F.greatest(-z, F.lit(0.0))) + F.col("_neg") * (low + F.greatest(z, F.lit(0.0)))
    residual, curve = weight * p - F.col("_pos"), weight * p * (1.0 - p)
    sums = rows.groupBy(*names).agg(
        F.sum(loss).alias("_loss"),
        F.sum(residual * F.col("_x")).alias("_gw"),
        F.sum(residual).alias("_gb"),
        F.sum(curve * F.col("_x") * F.col("_x")).alias("_hww"),
        F.sum(curve * F.col("_x")).alias("_hwb"),
        F.sum(curve).alias("_hbb"),
    )
    w, b, bw, bb = (F.col(n) for n in ("_w", "_b", "_best_w", "_best_b"))
    stepped = live.join(sums, list(names)).withColumns(
        {
            "_objective": 0.5 * w * w + c * F.col("_loss"),
            "_gw": w + c * F.col("_gw"),
            "_gb": c * F.col("_gb"),
            "_hww": 1.0 + c * F.col("_hww"),
            "_hwb": c * F.col("_hwb"),
            "_hbb": c * F.col("_hbb"),
        }
    )
    gw, gb, hww, hwb, hbb = (F.col(n) for n in ("_gw", "_gb", "_hww", "_hwb", "_hbb"))
    det = hww * hbb - hwb * hwb
    best = F.col("_best")
    worse = best.isNotNull() & (F.col("_objective") > best + 1e-12 * F.abs(best))
    # Halved back to where the best point is: nothing is left to gain.
    met = F.greatest(F.abs(w - bw), F.abs(b - bb)) < 1e-12
    flat = (F.greatest(F.abs(gw), F.abs(gb)) < 1e-10) | (det <= 0.0)
    return stepped.select(
        *names,
        F.when(worse, F.when(met, bw).otherwise((w + bw) / 2.0)).when(flat, w).otherwise(w - (hbb * gw - hwb * gb) / det).alias("_w"),
        F.when(worse, F.when(met, bb).otherwise((b + bb) / 2.0)).when(flat, b).otherwise(b - (hww * gb - hwb * gw) / det).alias("_b"),
        F.when(worse, bw).otherwise(w).alias("_best_w"),
        F.when(worse, bb).otherwise(b).alias("_best_b"),
        F.when(worse, best).otherwise(F.col("_objective")).alias("_best"),
        F.when(worse, met).otherwise(flat).alias("_done"),
    )


def category_parameters(
    fit: DataFrame, logit: str = "teacher_logit", minimum_class_rows: int = 10
) -> DataFrame:
    """Per-category fits with enough rows of both classes and a rising slope."""
    return platt_fit(fit, ["category"], logit, minimum_class_rows=minimum_class_rows).where(
        "coefficient > 0"
    )


def with_calibrations(
    df: DataFrame,
    category: DataFrame,
    overall: tuple[float, float],
    validated: DataFrame | None = None,
) -> DataFrame:
    """Raw, global and category probabilities side by side.

    A category without its own parameters uses the global ones. With ``validated`` (a
    table of categories), all others keep the raw probability in every variant.
    """
    parameters = category.select(
        "category", F.col("coefficient").alias("_c"), F.col("intercept").alias("_i")
    )
    joined = df.join(parameters, "category", "left")
    known = F.lit(True)
    if validated is not None:
        marks = validated.select("category", F.lit(True).alias("_known")).distinct()
        joined = joined.join(marks, "category", "left")
        known = F.coalesce("_known", F.lit(False))
    raw, logit = F.col("teacher_probability"), F.col("teacher_logit")
    single = logistic(logit, overall[0], overall[1])
    own = logistic(
        logit,
        F.coalesce(F.col("_c"), F.lit(overall[0])),
        F.coalesce(F.col("_i"), F.lit(overall[1])),
    )
    return joined.select(
        *df.columns,
        raw.alias("raw"),
        F.when(known, single).otherwise(raw).alias("global_platt"),
        F.when(known, own).otherwise(raw).alias("category_platt"),
    )


def calibration_report(calibrated: DataFrame, target: str = "target") -> DataFrame:
    """Probability metrics of the variants, the best one marked.

    Lowest log loss, then lowest Brier score, then the order raw, global, category.
    """
    report = probability_report(
        calibrated, {name: F.col(name) for name in VARIANTS}, target
    )
    place = F.array_position(F.array(*[F.lit(v) for v in VARIANTS]), F.col("variant"))
    best = report.agg(F.min_by("variant", F.struct("log_loss", "brier", place)))
    return report.withColumn("chosen", F.col("variant") == best.scalar())


def apply_chosen(calibrated: DataFrame, report: DataFrame) -> DataFrame:
    """The chosen variant as ``teacher_probability_calibrated``."""
    chosen = report.where("chosen").select("variant")
    value: Column = F.col("raw")
    named = calibrated.withColumn("_chosen", chosen.scalar())
    for name in VARIANTS[1:]:
        value = F.when(F.col("_chosen") == name, F.col(name)).otherwise(value)
    return named.withColumn("teacher_probability_calibrated", value.cast("float")).drop(
        "_chosen", *VARIANTS
    )


def apply_frozen(df: DataFrame, parameters: DataFrame) -> DataFrame:
    """Frozen category parameters; unlisted categories keep their raw probability."""
    listed = parameters.select(
        "category", F.col("coefficient").alias("_c"), F.col("intercept").alias("_i")
    )
    mapped = logistic(F.col("teacher_logit"), F.col("_c"), F.col("_i"))
    return df.join(listed, "category", "left").select(
        *df.columns,
        F.col("teacher_probability").alias("teacher_probability_raw"),
        F.coalesce(mapped, F.col("teacher_probability"))
        .cast("float")
        .alias("teacher_probability_calibrated"),
    )
