"""Inputs that once lost rows without a word now fail, or are counted by an audit."""

import pytest
from pyspark.sql import functions as F

from pairmatch.operators import calibration, joins, metrics, mining, ranking
from pairmatch.operators.scoring import evidence_scorer
from pairmatch.plans import ensemble

NAN = float("nan")


@pytest.mark.parametrize("row", [(4, "a", None), (4, None, 1.0), (4, "a", NAN)])
def test_ranks_and_metrics_refuse_missing_scores_and_keys(spark, row):
    df = spark.createDataFrame([(1, "a", 0.5), (2, "a", 0.1), (3, "b", 0.7), row], "id long, category string, s double")
    labelled = df.withColumn("target", F.lit(1))
    jobs = [
        lambda: ranking.percentile_ranks(df, ["category"], {"s": "p"}),
        lambda: ranking.average_ranks(df, ["category"], "s", "r"),
        lambda: metrics.average_precision(labelled, ["category"], "s"),
        lambda: metrics.spearman(labelled, ["category"], "s", "target"),
    ]
    for job in jobs:
        with pytest.raises(Exception, match="is missing"):
            job().collect()
    # A row number needs the group alone.
    numbered = ranking.ordinal(df, ["category"], [F.col("s"), F.col("id")], "n")
    if row[1] is None:
        with pytest.raises(Exception, match="category is missing"):
            numbered.collect()
    else:
        assert numbered.count() == 4


def test_unknown_categories_have_no_silent_thresholds(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "z"), (3, None)], "id long, category string")
    thresholds = spark.createDataFrame([("a", 0.4)], "category string, low double")
    with pytest.raises(Exception, match="no parameters for category"):
        joins.with_category_parameters(rows, thresholds, ["low"]).collect()
    kept = joins.with_category_parameters(rows, thresholds, ["low"], how="left").collect()
    assert sorted((r.id, r.low) for r in kept) == [(1, 0.4), (2, None), (3, None)]


def test_short_quotas_fail_unless_allowed(spark):
    rows = spark.createDataFrame([(i, "a" if i < 5 else "b") for i in range(8)], "id long, category string")
    quotas = lambda *q: spark.createDataFrame(list(q), "category string, quota long")
    order = [F.col("id")]
    assert mining.take_quota(rows, quotas(("a", 5), ("b", 1)), order).count() == 6
    for wrong in (quotas(("a", 6), ("b", 1)), quotas(("a", 1)), quotas(("a", 1), ("b", 1), ("c", 1))):
        with pytest.raises(Exception, match="for a quota of"):
            mining.take_quota(rows, wrong, order).collect()
    assert mining.take_quota(rows, quotas(("a", 6)), order, short="allow").count() == 5
    short = mining.quota_shortfall(rows, quotas(("a", 6), ("c", 2))).collect()
    assert sorted((r.category, r.quota, r.available, r.missing) for r in short) == [
        ("a", 6, 5, 1), ("b", None, 3, 0), ("c", 2, 0, 2),
    ]


def test_unfinished_calibration_fails(spark):
    rows = [(float(i % 7) - 3, i % 3 % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "teacher_logit double, target int")
    assert calibration.platt_fit(df).count() == 1
    with pytest.raises(RuntimeError, match="did not converge"):
        calibration.platt_fit(df, rounds=2)


def request(spark, pairs, items=None):
    items = items or [(i, "c" if i < 5 else "d", f"thing {i}", None) for i in range(1, 7)]
    models = [ensemble.Model(n, lambda length: evidence_scorer(), 10) for n in ("one", "two")]
    return ensemble.predict(
        spark.createDataFrame(pairs, "id1 long, id2 long"),
        spark.createDataFrame(items, "id long, category string, name string, attributes string"),
        ensemble.Ensemble(models, [0.25, 0.75]),
    )


def test_prediction_gives_one_row_per_requested_row(spark):
    pairs = [(1, 2), (2, 3), (1, 2), (1, 2), (3, 4)]
    got = request(spark, pairs).collect()
    assert sorted((r.id1, r.id2) for r in got) == sorted(pairs)
    assert len({r.predict for r in got if (r.id1, r.id2) == (1, 2)}) == 1


@pytest.mark.parametrize(
    ("pairs", "items", "what"),
    [
        ([(1, 2), (1, 99)], None, "unknown_item_rows"),
        ([(1, 6)], None, "cross_category_rows"),
        ([(1, 2)], [(1, "c", "x", None), (1, "c", "y", None), (2, "c", "z", None)], "duplicate_ids"),
        ([(1, 2)], [(None, "c", "x", None), (1, "c", "y", None), (2, "c", "z", None)], "null_ids"),
        ([(None, 2)], None, "unknown_item_rows"),
        ([], None, "no rows"),
    ],
)
def test_prediction_refuses_broken_requests(spark, pairs, items, what):
    with pytest.raises(ValueError, match=what):
        request(spark, pairs, items)
