import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairmatch.operators import audits
from pairmatch.operators import blending as B
from pairmatch.operators import calibration as C
from pairmatch.operators import routing as R
from pairmatch.plans import search
from test_ranking import brute_precision

SCORES = "id int, category string, a double, b double"


def test_simplex():
    vectors = B.simplex(3, 0.05)
    assert len(vectors) == 231 and vectors == sorted(vectors)
    assert all(math.isclose(sum(v), 1.0) for v in vectors)
    for bad in ((1, 0.1), (2, 0.3), (2, 0.0), (2, 2.0)):
        with pytest.raises(ValueError):
            B.simplex(*bad)


def test_global_and_category_blends(spark):
    df = spark.createDataFrame([(1, "A", 0.0, 2.0), (2, "A", 2.0, 0.0)], SCORES)
    out = B.blend_scores(df, ["a", "b"], (0.75, 0.25)).orderBy("id").collect()
    assert [r.predict for r in out] == [0.5, 1.5]
    df = spark.createDataFrame([(1, "A", 0.0, 2.0), (2, "B", 2.0, 0.0)], SCORES)
    table = spark.createDataFrame(
        [("A", [1.0, 0.0]), ("B", [0.0, 1.0])], "category string, weights array<double>"
    )
    out = B.blend_scores(df, ["a", "b"], table).orderBy("id").collect()
    assert [r.predict for r in out] == [0.0, 0.0]
    active = B.active_rows(df, table, 1).collect()
    assert [r.id for r in active] == [2]


def test_bad_weights_fail_closed(spark):
    df = spark.createDataFrame([(1, "unknown", 0.0, 1.0)], SCORES)
    table = spark.createDataFrame(
        [("known", [0.5, 0.5]), ("unknown", [0.9, 0.9])], "category string, weights array<double>"
    )
    for weights in (table, table.where("category = 'known'")):
        with pytest.raises(Exception, match="no valid ensemble weights"):
            B.blend_scores(df, ["a", "b"], weights).collect()
    for weights in ((0.5, 0.4), (-0.5, 1.5), (1.0,)):
        with pytest.raises(ValueError):
            B.blend_scores(df, ["a", "b"], weights)
    with pytest.raises(ValueError):
        B.blend_scores(df, ["a", "b"], (0.5, 0.5), "squared")


def test_residual_changes_only_its_categories(spark):
    rows = [(1, "weak", 0.1, 0.8), (2, "weak", 0.9, 0.2), (3, "strong", 10.0, -3.0), (4, "strong", 20.0, 4.0)]
    df = spark.createDataFrame(rows, SCORES)
    mixed = B.rank_residual(df, "a", "b", ["weak"], 0.75, 0.25)
    out = [r.predict for r in mixed.orderBy("id").collect()]
    assert out == [pytest.approx(5 / 12), pytest.approx(7 / 12), 10.0, 20.0]
    audit = audits.unchanged(mixed, F.col("category") == "weak", "a", "predict").first()
    assert (audit.routed_rows, audit.changed_outside_route) == (2, 0)
    assert [r.predict for r in B.rank_residual(df, "a", "b", [], 0.75, 0.25).orderBy("id").collect()] == [
        0.1, 0.9, 10.0, 20.0,
    ]


def brute_best(scores):
    """The order-dependent choice, one candidate after the other."""
    best, at = -math.inf, None
    for i, score in enumerate(scores):
        if score > best + 1e-12:
            best, at = score, i
        elif at is not None and abs(score - best) <= 1e-12 + 1e-5 * abs(best):
            at = i
    return at, best


def test_near_ties_prefer_later_vectors_without_raising_the_bar(spark):
    rng = random.Random(2)
    candidates = B.simplex(2, 0.05)
    rows, want = [], {}
    for key in range(60):
        base = rng.choice([0.0, 0.5, 0.9])
        scores = [base + rng.choice([0.0, 1e-13, 3e-6, -3e-6, 9e-6, 1e-4, -1e-4]) for _ in candidates]
        want[key] = brute_best(scores)
        rows += [(key, i, s, 1) for i, s in enumerate(scores)]
    rng.shuffle(rows)
    grid = spark.createDataFrame(rows, "key int, candidate int, average_precision double, rows long")
    for r in B.best_candidates(grid, ["key"], candidates).collect():
        at, best = want[r.key]
        assert tuple(r.weights) == candidates[at]
        assert r.training_score == best


def oof_rows(n=400, folds=5, categories=20):
    rng = random.Random(11)
    rows = []
    for i in range(n):
        fold, category = i % folds, (i // folds) % categories
        target = float((i // (folds * categories)) % 2)
        base = target * 0.4 + rng.random()
        rows.append((i, 10000 + i, target, f"c{category:02d}", fold, base, target * 0.9 + rng.random(),
                     rng.random(), i % 2))
    return rows


@pytest.fixture(scope="module")
def oof(spark):
    return spark.createDataFrame(
        oof_rows(2000),
        "id1 long, id2 long, target double, category string, fold int, base double, small double, "
        "surface_similarity double, identity_conflicts int",
    )


def test_grid_and_cross_fit_match_brute_force(spark, oof):
    rows = oof.collect()
    candidates = B.simplex(2, 0.25)
    grid = B.weight_grid(oof, ["base", "small"], candidates, range(5))
    got = {(r.category, r.candidate, r.cohort): r.average_precision for r in grid.collect()}
    assert len(got) == 20 * len(candidates) * 6
    for (category, at, cohort), value in list(got.items())[::37]:
        w = candidates[at]
        mine = [
            r for r in rows
            if r.category == category and (cohort == "all" or r.fold != int(cohort[-1]))
        ]
        want = brute_precision(
            [r.target for r in mine], [w[0] * r.base + w[1] * r.small for r in mine]
        )
        assert value == pytest.approx(want, abs=1e-12)
    weights = {r.fold: r for r in B.cross_fitted_weights(grid, candidates, "global").collect()}
    for fold in range(5):
        means = [
            np.mean([got[f"c{c:02d}", i, f"except_{fold}"] for c in range(20)])
            for i in range(len(candidates))
        ]
        at, best = brute_best(means)
        assert tuple(weights[fold].weights) == candidates[at]
        assert weights[fold].training_rows == sum(r.fold != fold for r in rows)
    per_category = B.cross_fitted_weights(grid, candidates, "category")
    assert per_category.count() == 100
    scored = B.cross_fitted_predictions(oof, ["base", "small"], per_category)
    assert scored.count() == len(rows) and scored.where("predict is null").count() == 0


def test_two_model_report_promotes_a_better_blend(spark, oof):
    thresholds = oof.select("category").distinct().withColumns(
        {"hard_negative_min_similarity": F.lit(0.2), "hard_positive_max_similarity": F.lit(0.8)}
    )
    gates = R.Gates(0.002, 4, 16, -0.2, -0.1, 1.0)
    report = search.two_model_report(oof, thresholds, "base", "small", range(5), 0.25, gates)
    rows = {r.variant: r for r in report.collect()}
    assert set(rows) == {"base+small__raw_logit__global", "base+small__category_rank__global"}
    for row in rows.values():
        assert row.uplift > 0.002 and row.positive_folds == 5 and row.final_weight > 0
    assert rows["base+small__raw_logit__global"].passed
    ranked = {r.variant: r for r in R.ranking(report).collect()}
    assert sorted(r.position for r in ranked.values()) == [1, 2]
    assert sum(r.winner for r in ranked.values()) == 1


def test_route_leaves_other_rows_alone(spark, oof):
    deltas = R.training_deltas(oof, range(5), F.col("base"), F.col("small"))
    route = R.select_route(deltas, 0.2, 4, 5)
    routed = R.apply_route(oof, route, F.col("base"), F.col("small"))
    audit = audits.unchanged(routed, F.col("routed"), "base", "predict").first()
    assert 0 < audit.routed_rows < audit.rows and audit.changed_outside_route == 0
    with pytest.raises(ValueError):
        R.select_route(deltas, 0.0)


def test_parity_gate(spark):
    df = spark.createDataFrame(
        [(c, float(i), float(i) + (5.0 if i == 3 else 0.0)) for c in "ab" for i in range(6)],
        "category string, x double, y double",
    )
    assert R.parity(df, "x", "x").first().passed
    bad = R.parity(df, "x", "y").first()
    assert not bad.passed and bad.max_abs_delta == 5.0


def brute_platt(x, y):
    """Plain gradient descent on the same objective, from many small Newton steps."""
    w = b = 0.0
    for _ in range(500):
        p = 1 / (1 + np.exp(-(w * x + b)))
        g = np.array([w + ((p - y) * x).sum(), (p - y).sum()])
        c = p * (1 - p)
        h = np.array([[1 + (c * x * x).sum(), (c * x).sum()], [(c * x).sum(), c.sum()]])
        step = np.linalg.solve(h, g)
        w, b = w - 0.3 * step[0], b - 0.3 * step[1]
    return w, b


def test_platt_fit_matches_the_minimum(spark):
    rng = np.random.default_rng(8)
    rows = []
    for category, slope in (("a", 1.5), ("b", 0.2), ("c", -1.0)):
        x = np.round(rng.normal(size=200) * 3, 2)
        y = (rng.random(200) < 1 / (1 + np.exp(-(slope * x - 0.5)))).astype(float)
        rows += [(category, float(u), float(v)) for u, v in zip(x, y, strict=True)]
    rows += [("few", 1.0, 1.0), ("few", 2.0, 0.0), ("one", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "category string, teacher_logit double, target double")
    got = {r.category: (r.coefficient, r.intercept) for r in C.platt_fit(df, ["category"]).collect()}
    assert set(got) == {"a", "b", "c", "few"}
    for category in "abc":
        mine = [r for r in rows if r[0] == category]
        want = brute_platt(np.array([r[1] for r in mine]), np.array([r[2] for r in mine]))
        assert got[category] == pytest.approx(want, abs=1e-6)
    kept = {r.category for r in C.category_parameters(df).collect()}
    assert kept == {"a", "b"}  # enough rows of both classes, rising slope
    overall = C.platt_fit(df).collect()
    assert len(overall) == 1


def test_platt_fit_survives_separable_scores(spark):
    rows = [(float(x), float(x > 0)) for x in (-40, -30, -20, 20, 30, 40)] * 5
    df = spark.createDataFrame(rows, "teacher_logit double, target double")
    row = C.platt_fit(df).first()
    assert 0.05 < row.coefficient < 5 and abs(row.intercept) < 1e-6


def test_frozen_calibration_leaves_unlisted_categories_raw(spark):
    df = spark.createDataFrame(
        [("a", 2.0, 0.88), ("b", 2.0, 0.88)], "category string, teacher_logit double, teacher_probability double"
    )
    frozen = spark.createDataFrame([("a", 0.5, -1.0)], "category string, coefficient double, intercept double")
    got = {r.category: r.teacher_probability_calibrated for r in C.apply_frozen(df, frozen).collect()}
    assert got == {"a": pytest.approx(0.5), "b": pytest.approx(0.88)}
