import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairmatch.operators import audits, metrics, summaries
from test_ranking import brute_ranks

PAIRS = "category string, target double, score double"


def test_macro_average_precision_is_unweighted_across_categories(spark):
    rows = [("a", 1, 1.0), ("a", 0, 0.0), ("b", 1, 0.9), ("b", 0, 0.8), ("b", 1, 0.7), ("b", 0, 0.6)]
    df = spark.createDataFrame([(c, float(t), s) for c, t, s in rows], PAIRS)
    report = metrics.average_precision(df, ["category"])
    got = {r.category: r.average_precision for r in report.collect()}
    assert got == {"a": pytest.approx(1.0), "b": pytest.approx((1 + 2 / 3) / 2)}
    assert metrics.macro(report).first().macro_average_precision == pytest.approx((1 + got["b"]) / 2)


def test_metric_input_audit_counts_what_the_metric_refuses(spark):
    rows = [("a", 0.0, 0.1), ("a", 2.0, 0.2), ("a", 1.0, math.nan), (None, 1.0, 0.3)]
    audit = audits.metric_input(spark.createDataFrame(rows, PAIRS), "score", "target", "category")
    assert audit.first().asDict() == {
        "rows": 4, "bad_scores": 1, "bad_labels": 1, "null_categories": 1,
    }
    for name in ("bad_scores", "bad_labels", "null_categories"):
        with pytest.raises(ValueError, match=name):
            audits.enforce(audit, name)
    empty = audits.metric_input(
        spark.createDataFrame([], PAIRS), "score", "target", "category"
    )
    assert empty.first().rows == 0


def test_single_class_categories_are_listed_not_averaged(spark):
    rows = [("a", 1.0, 0.9), ("a", 0.0, 0.1), ("b", 1.0, 0.2), ("c", 0.0, 0.2)]
    report = metrics.cohort_precision(
        spark.createDataFrame(rows, PAIRS), ["category"], F.col("score"), F.col("target"),
        {"all": F.lit(True)},
    )
    row = metrics.challenge_report(report).first()
    assert (row.macro_average_precision, row.eligible_categories) == (1.0, 1)
    assert row.excluded_categories == "b,c"


def test_stress_slice_counts(spark):
    rows = [
        (1.0, 0.9, "a", 0.2, 0), (1.0, 0.8, "a", 0.9, 0),
        (0.0, 0.2, "a", 0.9, 0), (0.0, 0.1, "a", 0.1, 1),
    ]
    df = spark.createDataFrame(
        rows, "target double, score double, category string, surface_similarity double, "
        "identity_conflicts int"
    ).withColumn("hard_negative_min_similarity", F.lit(0.8)).withColumn(
        "hard_positive_max_similarity", F.lit(0.3)
    )
    out = metrics.cohort_precision(
        df, ["category"], F.col("score"), F.col("target"), metrics.stress_cohorts()
    )
    got = {r.cohort: (r.rows, r.positives) for r in out.collect()}
    assert got == {
        "hard_negative": (3, 2), "hard_positive": (3, 1), "identity_conflict": (3, 2),
    }


def test_spearman_matches_brute_force_and_flags_constants(spark):
    rng = np.random.default_rng(3)
    rows = [("a", float(rng.integers(5)), float(rng.integers(9))) for _ in range(300)]
    rows += [("b", 1.0, float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "category string, x double, y double")
    got = {r.category: r.spearman for r in metrics.spearman(df, ["category"], "x", "y").collect()}
    a = [r for r in rows if r[0] == "a"]
    want = np.corrcoef(brute_ranks([r[1] for r in a]), brute_ranks([r[2] for r in a]))[0, 1]
    assert got["a"] == pytest.approx(want, abs=1e-12)
    assert got["b"] is None
    assert metrics.macro_spearman(df, "x", "y").first().undefined_categories == 1


def test_weighted_cross_entropy_gives_each_category_the_same_weight(spark):
    rows = [("a", 0.0, 2.0)] * 3 + [("b", 1.0, -1.0)]
    df = spark.createDataFrame(rows, "category string, target double, logit double")
    weights = summaries.inverse_category_weights(summaries.category_counts(df))
    loss = metrics.weighted_cross_entropy(df, "logit", "target", weights).first().loss
    a, b = math.log1p(math.exp(2.0)), math.log1p(math.exp(1.0))
    assert loss == pytest.approx((a + b) / 2)
    with pytest.raises(Exception, match="no weight for category"):
        metrics.weighted_cross_entropy(
            df, "logit", "target", weights.where("category = 'a'")
        ).collect()
    undecided = df.withColumn("target", F.lit(0.5))
    with pytest.raises(Exception, match="no positive sum"):
        metrics.weighted_cross_entropy(undecided, "logit", "target", None, 1.0).collect()


def test_hard_pair_thresholds_ignore_the_held_out_fold(spark):
    rows = [
        ("a", 0.0, 0.2, 0), ("a", 0.1, 0.8, 0), ("a", 0.9, 0.2, 0), ("a", 1.0, 0.4, 0),
        ("a", 0.0, 0.99, 1), ("a", 1.0, 0.01, 1),
    ]
    df = spark.createDataFrame(
        rows, "category string, target double, surface_similarity double, fold int"
    )
    row = summaries.hard_pair_thresholds(df.where("fold <> 1")).first()
    assert row.hard_negative_min_similarity == pytest.approx(0.65)
    assert row.hard_positive_max_similarity == pytest.approx(0.25)
    assert (row.negative_candidates, row.positive_candidates) == (2, 2)
    with pytest.raises(ValueError):
        summaries.hard_pair_thresholds(df, 0.9, 0.1)


def test_null_probability_is_not_turned_into_a_number(spark):
    from pairmatch.functions.numeric import clip, logistic

    df = spark.createDataFrame([(None,), (100.0,), (-100.0,)], "x double")
    low, high, null = sorted(
        (r.p for r in df.select(logistic(F.col("x")).alias("p")).collect()),
        key=lambda p: (p is None, p or 0),
    )
    assert null is None
    assert (low, high) == (pytest.approx(1 / (1 + math.exp(40))), pytest.approx(1.0))
    assert df.select(clip(F.col("x"), 0.0, 1.0).alias("c")).where("c is null").count() == 1
