import random

import pytest
from pyspark.sql import functions as F

from pairmatch.operators import audits, splits, summaries
from pairmatch.operators.graph import component_ids, component_roots

EDGES = "id1 long, id2 long"


def brute_components(edges):
    """Smallest reachable id per node."""
    neighbours = {}
    for a, b in edges:
        neighbours.setdefault(a, set()).add(b)
        neighbours.setdefault(b, set()).add(a)
    root = {}
    for start in sorted(neighbours):
        if start in root:
            continue
        todo = [start]
        while todo:
            node = todo.pop()
            if node not in root:
                root[node] = start
                todo += neighbours[node]
    return root


def chain(n):
    ids = list(range(n))
    random.Random(1).shuffle(ids)
    return list(zip(ids, ids[1:], strict=False))


GRAPHS = {
    "small": [(1, 2), (2, 3), (10, 11)],
    "self_loop": [(5, 5), (6, 7)],
    "chain": chain(200),
    "hub": [(999, i) for i in range(300)] + [(i, 5000 + i) for i in range(0, 300, 3)],
    "random": [(random.Random(i).randrange(400), random.Random(i + 9).randrange(400)) for i in range(260)],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components_match_a_graph_walk(spark, name):
    edges = GRAPHS[name]
    df = spark.createDataFrame(edges, EDGES).repartition(3)
    assert {r.id: r.root for r in component_roots(df).collect()} == brute_components(edges)


def test_component_ids_are_dense_and_keep_duplicate_edges(spark):
    edges = [(7, 8), (8, 7), (7, 8), (1, 2), (40, 41)]
    out = component_ids(spark.createDataFrame(edges, EDGES)).collect()
    assert sorted((r.id1, r.id2, r.component_id) for r in out) == [
        (1, 2, 0), (7, 8, 1), (7, 8, 1), (8, 7, 1), (40, 41, 2),
    ]


def labelled(spark, n=400, giant=0):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        component = 0 if i < giant else 1 + i // 2
        rows.append((i, i + 100000, float(rng.random() < 0.4), rng.choice("abc"), component))
    return spark.createDataFrame(
        rows, "id1 long, id2 long, target double, category string, component_id long"
    )


def test_folds_keep_components_whole_and_balance(spark):
    out = splits.component_folds(labelled(spark), 5, 2026)
    nested = splits.component_folds(out, 4, 7, "inner_fold")
    audit = audits.component_leakage(nested, ["fold", "inner_fold"]).first()
    assert (audit.fold_leaks, audit.inner_fold_leaks) == (0, 0)
    sizes = [r.n for r in out.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 16
    again = splits.component_folds(labelled(spark).repartition(5), 5, 2026)
    assert out.exceptAll(again).count() == 0
    other = splits.component_folds(labelled(spark), 5, 1)
    assert out.exceptAll(other).count() > 0


def test_giant_component_stays_in_one_fold(spark):
    out = splits.component_folds(labelled(spark, 400, giant=150), 5, 3)
    assert out.where("component_id = 0").select("fold").distinct().count() == 1
    assert out.count() == 400


def test_leakage_audit_raises(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "component_id long, fold int")
    audit = audits.component_leakage(df)
    assert audit.first().fold_leaks == 1
    with pytest.raises(ValueError, match="fold_leaks"):
        audits.enforce(audit, "fold_leaks")


@pytest.mark.parametrize("method", ["md5", "xxhash64"])
def test_hash_split_is_item_disjoint(spark, method):
    df = spark.createDataFrame([(i, (i * 37) % 500) for i in range(500)], EDGES)
    marked = df.withColumn("split", splits.hash_split(3, 0, method))
    train = {r.id for r in summaries.item_ids(marked.where("split = 'train'")).collect()}
    held = {r.id for r in summaries.item_ids(marked.where("split = 'validation'")).collect()}
    assert train and held and not train & held
    for bad in ((1, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            splits.hash_split(*bad)


def test_sample_and_head_are_deterministic(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(1000)], EDGES)
    assert splits.modulus_sample(df, 1, 5).count() == 1000
    sample = splits.modulus_sample(df, 4, 5)
    assert 150 < sample.count() < 350
    assert sample.exceptAll(splits.modulus_sample(df.repartition(9), 4, 5)).count() == 0
    head = splits.head_by_hash(df, 10, 3, ["id1", "id2"])
    assert head.exceptAll(splits.head_by_hash(df.repartition(6), 10, 3, ["id1", "id2"])).count() == 0
    order = splits.shuffle_order(df, 3).collect()
    assert sorted(r.position for r in order) == list(range(1, 1001))


def test_overlap_counts(spark):
    a = spark.createDataFrame([(1, 2), (2, 3)], EDGES)
    b = spark.createDataFrame([(3, 4)], EDGES)
    row = summaries.item_overlap(a, b).first()
    assert (row.first_items, row.second_items, row.shared_items) == (3, 2, 1)
    with pytest.raises(ValueError, match="shared_items"):
        audits.enforce(summaries.item_overlap(a, b), "shared_items")
