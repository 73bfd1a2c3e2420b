"""Stored layouts: what the plans read, and what broken tables do."""

import pytest
from pyspark.sql import functions as F

from pairmatch.operators import audits, joins
from pairmatch.plans.calibration import calibrate
from pairmatch.sources import layouts


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.range(2000).select(
        F.col("id").alias("id1"), (F.col("id") * 7 % 901).alias("id2"), (F.col("id") % 3).cast("double").alias("target"),
        (F.col("id") % 5).cast("int").alias("fold"),
    )


def test_bucketed_items_are_not_moved(spark, pairs):
    items = spark.range(1000).select("id", (F.col("id") % 4).cast("string").alias("category"), F.hex("id").alias("name"))
    stored = layouts.write_bucketed(items, "id", 4)
    joined = layouts.bucketed_pair_join(pairs, stored, ["name"])
    plan = plan_of(joined)
    assert plan.count("Bucketed: true") == 2 and plan.count("Exchange") == 2
    assert "Exchange hashpartitioning(id1" in plan and "Exchange hashpartitioning(id2" in plan
    want = joins.pair_join(pairs.where("id1 < 1000"), items, ["name"])
    key = ["id1", "id2", "target", "category", "left_name", "right_name"]
    assert sorted(map(tuple, joined.select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))


def test_footers_answer_counts_and_ranges(spark, pairs, tmp_path):
    path = str(tmp_path / "table")
    pairs.write.partitionBy("fold").parquet(path)
    whole = layouts.footer_summary(spark, path, ["id1"])
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), MIN(id1), MAX(id1)]" in plan.replace("`", "") or "count(*)" in plan.lower()
    assert tuple(whole.first()) == (2000, 0, 1999)
    per_fold = layouts.footer_summary(spark, path, ["id1"], "fold").collect()
    assert sorted((r.fold, r.rows, r.min_id1) for r in per_fold) == [(i, 400, i) for i in range(5)]
    # The caller's own session still reads by its own settings.
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
    with pytest.raises(ValueError, match="missing columns"):
        layouts.footer_summary(spark, path, ["absent"])


def test_unpicked_fold_folders_are_not_read(spark, pairs, tmp_path):
    path = str(tmp_path / "folds")
    layouts.write_folds(pairs, path)
    picked = spark.createDataFrame([(1, 5), (2, 1), (3, 9), (3, 9)], "fold int, weight int").where("weight > 4")
    rows = layouts.read_selected_folds(spark, path, picked)
    assert "dynamicpruning" in plan_of(rows)
    assert sorted((r.fold, r["count"]) for r in rows.groupBy("fold").count().collect()) == [(1, 400), (3, 400)]


def test_folds_with_defects_fail(spark, pairs):
    scored = pairs.withColumn("score", F.lit(0.5))
    assert layouts.union_valid_folds(scored, ["score"]).count() == 2000
    for broken in (
        scored.withColumn("score", F.when(F.col("id1") != 7, F.col("score"))),
        scored.withColumn("score", F.when(F.col("id1") == 7, F.lit(float("inf"))).otherwise(F.col("score"))),
        scored.withColumn("id2", F.when(F.col("id1") != 7, F.col("id2"))),
        scored.unionByName(scored.where("id1 = 7")),
    ):
        with pytest.raises(ValueError, match="fold=2|'fold': 2"):
            layouts.union_valid_folds(broken, ["score"])


@pytest.mark.parametrize("files", [1, 3, 16])
def test_ordered_files_keep_the_requested_order(spark, pairs, tmp_path, files):
    request = layouts.numbered_request(pairs, [F.col("id2"), -F.col("id1")])
    wanted = [(r.id1, r.id2) for r in sorted(pairs.collect(), key=lambda r: (r.id2, -r.id1))]
    path = str(tmp_path / "out")
    layouts.write_ordered(request.withColumn("predict", F.col("id1") * 0.5).repartition(7), path, files=files)
    back = sorted(layouts.read_ordered(spark, path, "id1 long, id2 long, predict double").collect(), key=lambda r: r.row)
    assert [(r.id1, r.id2) for r in back] == wanted and [r.row for r in back] == list(range(2000))


def test_validated_scores_name_what_is_wrong(spark, pairs):
    base = pairs.select("id1", "id2", "target")
    good = base.withColumn("predict", F.col("id1") * 0.1)
    made = joins.validated_scores(base, {"m": good.withColumn("target", F.col("target") + 5e-8)})
    assert {(r.id1, r.m) for r in made.collect()} == {(i, i * 0.1) for i in range(2000)}
    wrong = {
        "is missing in m": good.where("id1 <> 3"),
        "is not asked for": good.unionByName(good.where("id1 = 3").withColumn("id2", F.lit(-1).cast("long"))),
        "is repeated in m": good.unionByName(good.where("id1 = 3")),
        "has no finite score in m": good.withColumn("predict", F.when(F.col("id1") != 3, F.col("predict"))),
        "has other target in m": good.withColumn("target", F.col("target") + F.when(F.col("id1") == 3, 1e-6).otherwise(0.0)),
    }
    for text, other in wrong.items():
        with pytest.raises(Exception, match=text):
            joins.validated_scores(base, {"m": other}).collect()
    with pytest.raises(Exception, match="is repeated in the base"):
        joins.validated_scores(base.unionByName(base.where("id1 = 3")), {"m": good}).collect()
    with pytest.raises(ValueError, match="already has"):
        joins.validated_scores(base, {"target": good})


def test_lookups_refuse_repeated_items(spark, pairs):
    items = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id long, category string")
    with pytest.raises(Exception, match="several rows of key 2"):
        joins.with_category(pairs, items).collect()
    assert joins.with_category(pairs.where("id1 < 2"), items.limit(2).where("id = 1")).count() == 2


def test_differences_are_found_in_their_ranges(spark):
    rows = [(i, f"v{i}") for i in range(-50, 500)] + [(None, "x"), (7, "again")]
    df = spark.createDataFrame(rows, "k long, v string")
    changed = [(i, "new" if i == 123 else v) for i, v in rows if i not in (-3, 499)] + [(900, "more"), (None, "y")]
    other = spark.createDataFrame(changed, "k long, v string")
    prints = [audits.range_prints(x, "k", ["v"], 100) for x in (df, other)]
    got = {r.bucket: r.verified for r in audits.compare_prints(*prints).collect()}
    assert got == {-1: False, 0: True, 1: False, 2: True, 3: True, 4: False, 9: False, None: False}
    assert {(r.k, r.difference) for r in audits.differing_rows(df, other, "k", ["v"], 100).collect()} == {
        (-3, "unexpected"), (499, "unexpected"), (123, "changed"), (900, "missing"), (None, "changed")
    }
    assert audits.differing_rows(df, df.repartition(3), "k", ["v"], 100).count() == 0


def test_calibration_job_fits_validates_and_applies(spark):
    rows = spark.range(3000).select(
        F.col("id").alias("id1"),
        F.when(F.col("id") % 10 == 0, "rare").otherwise("big").alias("category"),
        ((F.xxhash64("id") % 1000) / 100.0).alias("teacher_logit"),
    )
    true = 1 / (1 + F.exp(-(0.4 * F.col("teacher_logit") + 0.5)))
    rows = rows.withColumn("target", (true > (F.pmod(F.hash("id1"), F.lit(1000)) / 1000.0)).cast("double"))
    rows = rows.withColumn("teacher_probability", 1 / (1 + F.exp(-F.col("teacher_logit"))))
    applied, report = calibrate(rows, F.col("id1") % 3 != 0)
    loss = {r.variant: r.log_loss for r in report.collect()}
    chosen = applied.first().variant
    assert applied.count() == 3000 and loss[chosen] == min(loss.values()) < loss["raw"]
    assert {r.variant for r in applied.select("variant").distinct().collect()} == {chosen}
    with pytest.raises(ValueError, match="0 to validate"):
        calibrate(rows, F.lit(True))
    with pytest.raises(Exception, match="neither for fitting"):
        calibrate(rows, F.when(F.col("id1") > 5, F.lit(True)))
    with pytest.raises(ValueError, match="one class only"):
        calibrate(rows.withColumn("target", F.lit(1.0)), F.col("id1") % 3 != 0)
