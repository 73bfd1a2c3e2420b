"""The calibration of a teacher as one job: fit, validate, promote, apply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmatch.operators import calibration as C
from pairmatch.session import publish, settle


def calibrate(
    df: DataFrame, fit: Column, minimum_class_rows: int = 10, logit: str = "teacher_logit", target: str = "target"
) -> tuple[DataFrame, DataFrame]:
    """All rows with ``variant`` and ``teacher_probability_calibrated``, and the report they rest on.

    ``fit`` marks the rows that the slopes are fitted on, per category and over all; the others
    validate: the variant with the least log loss there (then Brier score, then the simpler
    one) is promoted and applied to every row. A category with too few rows of a class, or
    with a falling slope, uses the fit over all categories. Rows on neither side of ``fit``
    (null) fail, and so does a side without rows.
    """
    told = F.when(fit.isNull(), F.raise_error(F.lit("a row is neither for fitting nor for validation"))).otherwise(fit)
    rows = publish(df.withColumn("_fit", told.cast("boolean")))
    sides = rows.agg(F.count_if("_fit").alias("fit"), F.count_if(~F.col("_fit")).alias("held")).first()
    if not sides["fit"] or not sides["held"]:
        raise ValueError(f"{sides['fit']} rows to fit and {sides['held']} to validate")
    fitted = rows.where("_fit")
    overall = C.platt_fit(fitted, (), logit, target).first()
    if overall is None:
        raise ValueError("the rows to fit hold one class only")
    own = settle(C.category_parameters(fitted, logit, minimum_class_rows))
    variants = publish(C.with_calibrations(rows, own, (overall["coefficient"], overall["intercept"])))
    report = settle(C.calibration_report(variants.where("not _fit"), target))
    chosen = report.where("chosen").select("variant")
    applied = C.apply_chosen(variants, report).withColumn("variant", chosen.scalar())
    return applied.drop("_fit"), report
