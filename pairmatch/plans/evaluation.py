"""Scoring a labelled pair table and reporting on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmatch.operators import audits, metrics
from pairmatch.operators.joins import with_category_parameters
from pairmatch.operators.scoring import Scorer, evidence_scorer, evidence_table, score_pairs
from pairmatch.session import settle
from pairmatch.sources.tables import write_parquet

PREDICTION_COLUMNS = (
    "id1",
    "id2",
    "target",
    "category",
    "score",
    "surface_similarity",
    "identity_matches",
    "identity_conflicts",
    "missing_identity_fields",
)
THRESHOLDS = ("hard_negative_min_similarity", "hard_positive_max_similarity")


def predictions(
    pairs: DataFrame, items: DataFrame, scorer: Scorer | None = None, bidirectional: bool = False
) -> DataFrame:
    """Scored pairs with their diagnostics."""
    table = evidence_table(pairs, items)
    scored = score_pairs(table, scorer or evidence_scorer(), bidirectional)
    return scored.select(*PREDICTION_COLUMNS)


def human_report(scored: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """Macro average precision overall and, with thresholds, on the stress slices."""
    cohorts = {"all": F.lit(True)}
    table = scored
    if thresholds is not None:
        table = with_category_parameters(scored, thresholds, THRESHOLDS)
        cohorts.update(metrics.stress_cohorts())
    ranked = metrics.cohort_precision(
        table, ["category"], F.col("score"), F.col("target"), cohorts
    )
    return metrics.challenge_report(ranked)


def evaluate(
    pairs: DataFrame,
    items: DataFrame,
    path: str | None = None,
    scorer: Scorer | None = None,
    thresholds: DataFrame | None = None,
    expected_categories: int | None = None,
    overwrite: bool = False,
) -> DataFrame:
    """Score once, optionally publish the predictions, check them and report."""
    scored = predictions(pairs, items, scorer)
    if path is None:
        scored = settle(scored)
    else:
        write_parquet(scored, path, overwrite=overwrite)
        scored = pairs.sparkSession.read.parquet(path)
    audits.enforce(
        audits.metric_input(scored, "score", "target", "category"),
        "bad_scores",
        "bad_labels",
        "null_categories",
    )
    if expected_categories is not None:
        audits.enforce(
            audits.category_coverage(scored, expected_categories=expected_categories),
            "category_surplus",
        )
    return human_report(scored, thresholds)
