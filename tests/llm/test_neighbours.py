import numpy as np
from pyspark.sql import functions as F

from pairmatch.llm.neighbours import nearest


def brute(rows, k=10):
    ids = np.array([i for i, v in rows])
    points = np.array([v for _, v in rows], float)
    out = {}
    for i, v in rows:
        if i % 100 == 0:
            far = np.sqrt(((points - np.array(v, float)) ** 2).sum(1))
            order = [j for j in np.lexsort((ids, far)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(far[j])) for j in order]
    return out


def frame(spark, rows):
    return spark.createDataFrame(
        [(int(i), None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows],
        "vec_id long, embedding array<float>",
    )


def by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_recall_over_several_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(32).astype(np.float32)) for i in range(3000)]
    got, want = by_query(nearest(frame(spark, rows), block_rows=700, query_rows=10)), brute(rows)
    assert set(got) == set(want)
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    scores = {q: dict(brute(rows, 3000)[q]) for q in list(want)[:3]}
    for q in scores:
        assert all(abs(scores[q][v] - s) < 1e-9 for v, s in got[q])


def test_copies_ties_and_unusable_vectors(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(i, same) for i in range(40)]
    rows += [(100, same), (200, [0.0, 0.0, 0.0]), (300, None), (400, [1.0, None, 2.0]), (500, [float("nan"), 1.0, 1.0])]
    rows += [(600, [float("inf"), 1.0, 1.0]), (700, [1.0, 2.0]), (701, [1.0, 2.5]), (800, [])]
    got = by_query(nearest(frame(spark, rows).withColumn("block", F.lit(1)), block_rows=16))
    assert set(got) == {0, 100, 700}
    assert [v for v, _ in got[0]] == list(range(1, 11)) and {s for _, s in got[0]} == {0.0}
    assert [v for v, _ in got[100]] == list(range(10))
    assert got[700] == [(701, 0.5)]


def test_few_and_no_rows(spark):
    assert by_query(nearest(frame(spark, [(100, [1.0])]))) == {}
    assert by_query(nearest(frame(spark, []))) == {}
    assert by_query(nearest(frame(spark, [(0, [1.0]), (1, [4.0])]))) == {0: [(1, 3.0)]}


def counted(base, ids, point, own, k=10, projections=64, share=0.58, opening=0.4, widen=1.2, ratio=1.1, seed=7):
    """The search of one block for one query, with collisions counted for every vector and round."""
    n = len(base)
    lines = np.random.default_rng(seed).standard_normal((base.shape[1], projections))
    placed, spot = base @ lines, point @ lines
    ladder, aside = np.sort(placed, axis=0), max(k, int(n * opening / 2))
    at = [ladder[:, i].searchsorted(spot[i]) for i in range(projections)]
    spans = [
        max(abs(ladder[min(n - 1, a + aside), i] - spot[i]), abs(ladder[max(0, a - aside), i] - spot[i]))
        for i, a in enumerate(at)
    ]
    half, far = max(float(np.median(spans)), 1e-12), np.sqrt(((base - point) ** 2).sum(1))
    others = ids != own
    while True:
        verified = (np.abs(placed - spot) <= half).sum(1) >= np.ceil(share * projections)
        found = np.flatnonzero(verified & others)
        best = found[np.lexsort((ids[found], far[found]))][:k]
        if verified.all() or (len(best) == min(k, others.sum()) and far[best[-1]] <= ratio * half):
            return [(int(ids[i]), float(far[i])) for i in best]
        half *= widen


def assorted(rng):
    apart = rng.standard_normal((700, 16))
    tight = apart[rng.integers(0, 20, 400)] + 0.01 * rng.standard_normal((400, 16))
    close = apart[0] + 1e-5 * rng.standard_normal((300, 16))
    many = np.repeat(apart[1:3], 100, axis=0)
    scales = rng.standard_normal((200, 16)) * 10.0 ** rng.integers(-9, 9, (200, 1))
    points = rng.permutation(np.concatenate([apart, tight, close, many, scales]).astype(np.float32))
    return [(i if i % 7 else i - i % 2, v) for i, v in enumerate(points)]


def test_rows_are_those_of_counting_for_every_vector(spark):
    rows = assorted(np.random.default_rng(3))
    got = by_query(nearest(frame(spark, rows), every=20, query_rows=9, held_queries=25))
    ids, points = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    order = np.argsort(ids, kind="stable")
    ids, points = ids[order], points[order]
    asked = {i for i in ids.tolist() if i % 20 == 0}
    assert set(got) == asked
    for own in asked:
        turns = [counted(points, ids, p, own) for p in points[ids == own]]
        want = sorted((s, v) for t in turns for v, s in t)[:10]
        assert [v for v, _ in got[own]] == [v for _, v in want], own
        assert np.allclose([s for _, s in got[own]], [s for s, _ in want], rtol=1e-12, atol=0)


def test_blocks_after_the_first_give_the_rows_of_counting_in_each(spark):
    from pairmatch.llm.neighbours import dealt, usable

    rows = assorted(np.random.default_rng(4))
    table = frame(spark, rows).dropDuplicates(["vec_id"])
    got = by_query(nearest(table, every=20, block_rows=300))
    good = usable(table, "vec_id", "embedding").withColumn("size", F.size("vec"))
    blocks = -(-good.count() // 300)
    counts = {"blocks": blocks, "shards": 1, "chunks": 1}
    plan = good.select("size", *(F.lit(n).alias(c) for c, n in counts.items())).distinct()
    held = {}
    for r in dealt(good, plan, 20).where(~F.col("query")).collect():
        held.setdefault(r.block, []).append((r.id, r.vec))
    points = {i: np.array(v) for b in held.values() for i, v in b}
    assert len(held) == blocks and set(got) == {i for i in points if i % 20 == 0}
    for own in got:
        found = []
        for block in held.values():
            ids, base = (np.array(x) for x in zip(*sorted(block)))
            found += counted(base, ids, points[own], own)
        want = sorted((s, v) for v, s in found)[:10]
        assert [v for v, _ in got[own]] == [v for _, v in want], own


def test_rows_do_not_depend_on_how_many_queries_a_task_takes(spark):
    rows = assorted(np.random.default_rng(4))
    want = by_query(nearest(frame(spark, rows), every=20, block_rows=300))
    for sizes in ({"query_rows": 1}, {"held_queries": 10}, {"query_rows": 7, "held_queries": 1}):
        assert by_query(nearest(frame(spark, rows), every=20, block_rows=300, **sizes)) == want


def test_vectors_are_not_copied_for_every_batch_of_queries(spark):
    from pairmatch.llm.neighbours import dealing, dealt, usable

    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(8).astype(np.float32)) for i in range(2000)]
    good = usable(frame(spark, rows), "vec_id", "embedding").withColumn("size", F.size("vec"))
    counts = good.groupBy("size").agg(F.lit(2000).alias("rows"), F.lit(20).alias("asked"))
    sent = dealt(good, dealing(counts, 100, 262144), 100)
    assert sent.where(~F.col("query")).count() == 2000 and sent.where("query").count() == 20
    # 15.4 million vectors: one copy of each, and fewer copies of queries than vectors.
    large = counts.select("size", F.lit(15_400_000).alias("rows"), F.lit(154_000).alias("asked"))
    deal = dealing(large, 16384, 262144).first()
    assert deal.chunks == 1 and deal.blocks == 940 and 4 <= deal.shards <= 100


def test_vectors_of_many_lengths_and_both_precisions(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(1 + i % 5)) for i in range(1000)]
    schema = "vec_id long, embedding array<double>"
    double = spark.createDataFrame([(i, v.tolist()) for i, v in rows], schema)
    got, points = by_query(nearest(double)), dict(rows)
    assert set(got) == set(range(0, 1000, 100))
    for own, found in got.items():
        assert len(found) == 10 and all(len(points[v]) == len(points[own]) for v, _ in found)
        assert all(abs(np.linalg.norm(points[v] - points[own]) - s) < 1e-12 for v, s in found)
    assert by_query(nearest(double.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"))))
