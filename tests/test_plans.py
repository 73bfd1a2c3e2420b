import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairmatch.operators import audits, batches, learning, summaries
from pairmatch.operators.scoring import evidence_scorer, text_scorer
from pairmatch.plans import ensemble, evaluation, pair_tables
from pairmatch.sources import tables

ITEM = "id long, category string, name string, attributes string"


@pytest.fixture(scope="module")
def items(spark):
    rng = random.Random(3)
    rows = [
        (i, "ab"[i // 100 % 2], f"{rng.choice(['red', 'blue'])} {rng.choice(['bolt', 'gear', 'ring'])}",
         f'{{"brand":"B{rng.randrange(3)}","model":"M{rng.randrange(5)}"}}')
        for i in range(400)
    ]
    return spark.createDataFrame(rows, ITEM)


@pytest.fixture(scope="module")
def pairs(spark):
    rng = random.Random(5)
    rows = [(i, i + 1, float(rng.random() < 0.4)) for i in range(200, 399) if i != 299]
    return spark.createDataFrame(rows, "id1 long, id2 long, target double")


def test_pair_tables_are_written_and_audited(spark, items, pairs, tmp_path):
    soft = spark.createDataFrame(
        [(i, i + 1, (i % 10) / 9) for i in range(199) if i != 99], "id1 long, id2 long, target double"
    )
    folds = pairs.withColumns({"component_id": F.col("id1"), "fold": (F.col("id1") % 5).cast("int")})
    config = pair_tables.PairTableConfig(3, 0, 2, 1)
    report = pair_tables.write_pair_tables(
        spark, soft, items, folds, items, str(tmp_path / "out"), config
    )
    values = {(r.dataset, r.metric): r.value for r in report.collect()}
    assert values["item_overlap", "shared_items"] == 0
    assert values["human_all", "rows"] == 198
    train = spark.read.parquet(str(tmp_path / "out" / "soft_train"))
    held = spark.read.parquet(str(tmp_path / "out" / "soft_validation"))
    assert train.count() == values["soft_train", "rows"]
    assert summaries.item_overlap(train, held).first().shared_items == 0
    with pytest.raises(Exception, match="already exists"):
        pair_tables.write_pair_tables(
            spark, soft, items, folds, items, str(tmp_path / "out"), config
        )
    with pytest.raises(ValueError, match="shared_items"):
        pair_tables.write_pair_tables(
            spark, soft.union(pairs), items, folds, items, str(tmp_path / "bad"), config
        )


def test_cross_category_pairs_are_refused(spark, items, tmp_path):
    crossing = spark.createDataFrame([(99, 100, 0.5)], "id1 long, id2 long, target double")
    folds = crossing.withColumns({"component_id": F.lit(0), "fold": F.lit(0)})
    soft = spark.createDataFrame([(1, 2, 0.5)], "id1 long, id2 long, target double")
    with pytest.raises(ValueError, match="category_mismatch_rows"):
        pair_tables.write_pair_tables(spark, soft, items, folds, items, str(tmp_path / "x"))


def test_folds_weights_and_predictions_round_trip(spark, pairs, tmp_path):
    tagged = tables.union_folds({f: pairs.where(F.col("id1") % 3 == f) for f in range(3)})
    tables.write_parquet(tagged, str(tmp_path / "folds"), ["fold"])
    back = tables.read_folds(spark, str(tmp_path / "folds"), ["id1", "id2", "target"])
    assert back.exceptAll(tagged.select(*back.columns)).count() == 0
    pruned = tables.fold_filter(back, include_fold=1)
    assert "PartitionFilters: [isnotnull(fold" in pruned._jdf.queryExecution().toString()
    for bad in ({"include_fold": 1, "exclude_fold": 2}, {"include_inner_fold": 0}):
        with pytest.raises(ValueError):
            tables.fold_filter(back, **bad)
    tables.write_predictions(pairs.withColumnRenamed("target", "predict"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["id1", "id2", "predict"]
    with pytest.raises(ValueError, match="missing columns"):
        tables.write_predictions(pairs, str(tmp_path / "none"))
    path = tmp_path / "weights.json"
    path.write_text(json.dumps([{"category": "a", "weights": [0.25, 0.75]}]))
    assert tables.read_weights(spark, str(path)).first().weights == [0.25, 0.75]


def test_output_and_shard_audits(spark, pairs):
    good = pairs.withColumnRenamed("target", "predict")
    row = audits.output_table(good, pairs).first()
    assert (row.uncovered_pairs, row.unexpected_pairs, row.non_finite_rows) == (0, 0, 0)
    short = audits.output_table(good.where("id1 <> 200"), pairs)
    with pytest.raises(ValueError, match="uncovered_pairs"):
        audits.enforce(short, "uncovered_pairs")
    rows = spark.createDataFrame([(0,), (1,), (1,), (5,)], "r long")
    got = audits.shard_completeness(rows, "r", 4).first()
    assert (got.duplicate_rows, got.out_of_range_rows, got.missing_rows) == (1, 1, 2)


def test_contract_audit_sees_nulls_and_duplicates(spark):
    schema = "id1 long, id2 long, target double, category string, fold int"
    base = spark.createDataFrame([(1, 2, 1.0, "a", 0), (3, 4, 0.0, None, 0)], schema)
    other = spark.createDataFrame(
        [(1, 2, 1.0 + 1e-9, "a", 0), (1, 2, 1.0, "a", 0), (3, 4, 0.0, None, 0), (9, 9, 0.0, "b", 1)], schema
    )
    got = audits.contract(base, other, tolerance=1e-7).first()
    assert (got.duplicate_keys, got.unexpected_keys, got.uncovered_keys, got.mismatched_keys) == (1, 1, 0, 0)
    strict = audits.contract(base, other.withColumn("category", F.lit("z"))).first()
    assert strict.mismatched_keys == 2


def test_evaluation_publishes_and_checks(spark, items, pairs, tmp_path):
    report = evaluation.evaluate(pairs, items, str(tmp_path / "p"), expected_categories=2)
    assert report.count() == 1
    stored = spark.read.parquet(str(tmp_path / "p"))
    assert stored.columns == list(evaluation.PREDICTION_COLUMNS) and stored.count() == 198
    with pytest.raises(ValueError, match="category_surplus"):
        evaluation.evaluate(pairs, items, expected_categories=3)
    with pytest.raises(ValueError, match="bad_labels"):
        evaluation.evaluate(pairs.withColumn("target", F.lit(0.5)), items)


def test_ensemble_routes_and_skips_inactive_rows(spark, items, pairs):
    seen = []

    def model(length):
        seen.append(length)
        return text_scorer(float(length), 0.0)

    models = (ensemble.Model("t", model, 10, {"b": 20}), ensemble.Model("e", lambda _: evidence_scorer()))
    out = ensemble.predict(pairs, items, ensemble.Ensemble(models, {"a": (1.0, 0.0), "b": (1.0, 0.0)}))
    assert sorted(seen) == [10, 20]
    assert audits.output_table(out, pairs).first().uncovered_pairs == 0
    ten = ensemble.predict(
        pairs, items, ensemble.Ensemble((models[0], models[1]), (1.0, 0.0))
    )
    assert ten.exceptAll(out).count() == 0
    with pytest.raises(Exception, match="no valid ensemble weights"):
        ensemble.predict(pairs, items, ensemble.Ensemble(models, {"a": (1.0, 0.0)})).collect()


def test_matcher_learns_and_scores_out_of_fold(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        target = float(rng.random() < 0.5)
        rows.append((i, i + 1000, target, "ab"[i % 2], i % 4, target * 0.5 + rng.random() * 0.5,
                     int(target + rng.random()), int(1.4 - target + rng.random() * 0.5), rng.randrange(2)))
    df = spark.createDataFrame(
        rows, "id1 long, id2 long, target double, category string, fold int, " + ", ".join(
            f"{n} double" if n == "surface_similarity" else f"{n} int" for n in learning.FEATURES)
    )
    model = learning.train_matcher(df, confidence_gamma=1.0)
    assert model.coefficients[0] > 0 > model.coefficients[2]
    scored = learning.out_of_fold_scores(df, range(4))
    assert scored.count() == 400 and scored.select("id1").distinct().count() == 400
    means = {r.target: r.m for r in scored.groupBy("target").agg(F.avg("score").alias("m")).collect()}
    assert means[1.0] > means[0.0]
    _, report = learning.select_model(
        df.where("fold > 0"), df.where("fold = 0"), [(0.0, 10.0), (0.0, 1e-4)]
    )
    rows = report.collect()
    assert sum(r.chosen for r in rows) == 1
    assert max(rows, key=lambda r: r.metric).metric == next(r.metric for r in rows if r.chosen)


def test_soft_rows_keep_the_loss_weight(spark):
    df = spark.createDataFrame(
        [("a", 0.25, 1.0), ("a", 1.0, 0.0), ("b", 0.5, 0.0)], "category string, target double, f double"
    )
    rows = learning.training_rows(df, ["f"]).collect()
    assert len(rows) == 5
    total = {}
    for r in rows:
        total[r.category] = total.get(r.category, 0.0) + r.row_weight
    assert total["a"] == pytest.approx(total["b"]) == pytest.approx(1.5)


def test_lineage_verdict(spark, pairs):
    columns = ["id1", "id2", "target"]
    def prints(df):
        return audits.fingerprint(df, columns).select(F.lit("pairs").alias("table_name"), "*")
    assert audits.lineage(prints(pairs), prints(pairs.repartition(7))).first().verified
    changed = pairs.withColumn("target", F.when(F.col("id1") == 250, 0.5).otherwise(F.col("target")))
    assert not audits.lineage(prints(changed), prints(pairs)).first().verified


@pytest.mark.parametrize("sizes", [[10, 3, 0, 25, 1, 1, 1, 40], [5] * 7, [64], [2, 2]])
def test_carried_batches_follow_a_sequential_reader(spark, sizes):
    """The rows left open by a chunk wait for the longest rows of the next one."""
    rows, rng = [], np.random.default_rng(len(sizes))
    for chunk, n in enumerate(sizes):
        rows += [(len(rows) + i, chunk, chunk, int(rng.integers(0, 50))) for i in range(n)]
    df = spark.createDataFrame(rows, "id1 long, id2 long, chunk long, size int")
    got = batches.carried_batches(df, 8, F.col("size"), 4).collect()
    made = {}
    for r in got:
        made.setdefault(r.batch_id, {})[r.batch_row] = r
    by_chunk = {c: [r for r in got if r.chunk == c] for c in range(len(sizes))}
    pending, want = [], []
    for chunk in range(len(sizes)):
        order = sorted(by_chunk[chunk], key=lambda r: r.size)
        if pending:
            needed = 8 - len(pending)
            if len(order) < needed:
                pending += [r.size for r in order]
                continue
            want.append(sorted(pending + [r.size for r in order[len(order) - needed :]]))
            order, pending = order[: len(order) - needed], []
        full = len(order) - len(order) % 8
        want += [sorted(r.size for r in order[i : i + 8]) for i in range(0, full, 8)]
        pending = [r.size for r in order[full:]]
    if pending:
        want.append(sorted(pending))
    assert [sorted(r.size for r in made[b].values()) for b in sorted(made)] == want
    assert all(sorted(m) == list(range(len(m))) for m in made.values())
