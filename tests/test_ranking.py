import numpy as np
import pytest
from pyspark.sql import functions as F

from pairmatch.functions.hashing import hash_slot, seeded_hash
from pairmatch.operators import metrics, ranking
from pairmatch.operators.ranking import average_ranks, first_rows, ordinal, percentile_ranks, quantiles, running_sums


def brute_precision(target, score):
    """Average precision with one threshold per distinct score."""
    target, score = np.asarray(target, float), np.asarray(score, float)
    if target.sum() == 0:
        return 0.0
    total, seen = 0.0, 0.0
    for threshold in sorted(set(score.tolist()), reverse=True):
        above = score >= threshold
        hits = target[above].sum()
        total += (hits - seen) / target.sum() * hits / above.sum()
        seen = hits
    return total


def brute_ranks(values):
    values = np.asarray(values, float)
    return [(values < v).sum() + ((values == v).sum() + 1) / 2 for v in values]


@pytest.fixture(scope="module")
def skewed(spark):
    """One group with most rows, heavy ties, and small groups."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(3000):
        group = "hot" if rng.random() < 0.8 else f"g{rng.integers(4)}"
        value = 0.5 if rng.random() < 0.3 else float(rng.integers(400)) / 7.0
        rows.append((i, group, value, float(rng.random() < 0.3)))
    return rows, spark.createDataFrame(rows, "id long, k string, v double, y double")


@pytest.mark.parametrize("slots", [2, 3, 16, 200])
def test_average_precision_matches_brute_force_for_any_slot_count(skewed, slots):
    rows, df = skewed
    out = metrics.cohort_precision(
        df, ["k"], F.col("v"), F.col("y"), {"all": F.lit(True), "even": F.col("id") % 2 == 0}, slots
    )
    for row in out.collect():
        mine = [r for r in rows if r[1] == row.k and (row.cohort == "all" or r[0] % 2 == 0)]
        assert row.rows == len(mine)
        assert row.positives == sum(r[3] for r in mine)
        assert row.average_precision == pytest.approx(
            brute_precision([r[3] for r in mine], [r[2] for r in mine]), abs=1e-12
        )


def test_average_ranks_match_brute_force(skewed):
    rows, df = skewed
    got = {r.id: (r.rank, r.size) for r in average_ranks(df, ["k"], "v", "rank", "size").collect()}
    assert len(got) == len(rows)
    for group in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == group]
        for row, rank in zip(mine, brute_ranks([r[2] for r in mine]), strict=True):
            assert got[row[0]] == (rank, len(mine))


@pytest.mark.parametrize("slots", [2, 7, 64])
@pytest.mark.parametrize("keys", [["k"], []])
def test_ordinal_is_a_complete_row_number(skewed, slots, keys):
    rows, df = skewed
    out = ordinal(df, keys, [-F.col("v"), F.col("id")], "n", slots=slots).collect()
    assert len(out) == len(rows)
    for group in {r[1] for r in rows} if keys else {None}:
        mine = sorted(
            (r for r in rows if not keys or r[1] == group), key=lambda r: (-r[2], r[0])
        )
        want = {r[0]: i + 1 for i, r in enumerate(mine)}
        assert {r.id: r.n for r in out if not keys or r.k == group} == want


@pytest.mark.parametrize("method", ["md5", "xxhash64"])
def test_hash_slots_follow_the_hash(skewed, method):
    rows, df = skewed
    hashed = df.withColumn("h", seeded_hash(3, "id", method=method))
    out = ordinal(
        hashed, [], [F.col("h"), F.col("id")], "n", slot=hash_slot(F.col("h"), 16, method)
    ).collect()
    ordered = sorted(out, key=lambda r: (r.h, r.id))
    assert [r.n for r in ordered] == list(range(1, len(rows) + 1))


def test_running_totals_cover_the_group(skewed):
    _, df = skewed
    cells = df.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    out = running_sums(cells, ["k"], F.col("v"), ["n"]).groupBy("k").agg(
        F.max("n_upto").alias("last"), F.max("n_total").alias("total"), F.sum("n").alias("sum")
    )
    assert all(r.last == r.total == r.sum for r in out.collect())


def test_percentile_rank_forms(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (2, "a", 5.0), (3, "a", 9.0), (4, "b", 1.0)],
                               "id int, c string, s double")
    plain = {r.id: r.p for r in percentile_ranks(df, ["c"], {"s": "p"}).collect()}
    assert plain == {1: 1.5 / 4, 2: 1.5 / 4, 3: 3 / 4, 4: 1 / 2}
    zero = {r.id: r.p for r in percentile_ranks(df, ["c"], {"s": "p"}, zero_one=True).collect()}
    assert zero == {1: 0.25, 2: 0.25, 3: 1.0, 4: 0.0}


def test_result_does_not_depend_on_partitioning(skewed):
    _, df = skewed
    once = metrics.average_precision(df, ["k"], "v", "y").orderBy("k").collect()
    again = metrics.average_precision(
        df.repartition(7).orderBy(F.rand(1)), ["k"], "v", "y"
    ).orderBy("k").collect()
    for a, b in zip(once, again, strict=True):
        assert (a.rows, a.positives) == (b.rows, b.positives)
        assert a.average_precision == pytest.approx(b.average_precision, abs=1e-12)


@pytest.mark.parametrize("rows", [1, 3, 40, 100_000])
def test_first_rows_are_those_of_a_full_sort(skewed, spark, rows):
    data, df = skewed
    quotas = df.select("k").distinct().withColumn("quota", F.lit(rows).cast("bigint"))
    # The leading column has heavy ties, which the next one breaks.
    order = [F.col("y"), -F.col("v"), F.col("id")]
    got = first_rows(df, ["k"], quotas, order, "at").collect()
    for group in {r[1] for r in data}:
        want = sorted((r for r in data if r[1] == group), key=lambda r: (r[3], -r[2], r[0]))[:rows]
        assert {r.id: r["at"] for r in got if r.k == group} == {r[0]: i + 1 for i, r in enumerate(want)}


def test_first_rows_sort_little_more_than_the_quota(spark, monkeypatch):
    df = spark.range(200_000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("k"),
        (F.xxhash64("id") % 1000).alias("tie"),
        "id",
    )
    sorted_rows = []
    inner = ranking.ordinal
    monkeypatch.setattr(ranking, "ordinal", lambda df, *a, **k: sorted_rows.append(df.count()) or inner(df, *a, **k))
    quotas = df.select("k").distinct().withColumn("quota", F.lit(50).cast("bigint"))
    got = first_rows(df, ["k"], quotas, [F.lit(0), F.col("tie"), F.col("id")], "at")
    assert got.groupBy("k").count().where("count <> 50").count() == 0
    # 8 groups of 50; a plain cut of the heaviest group alone would sort two thirds of all rows.
    assert sorted_rows[0] < 0.02 * 200_000
    with pytest.raises(Exception, match="k is missing"):
        first_rows(df.withColumn("k", F.when(F.col("id") > 5, F.col("k"))), ["k"], quotas, [F.col("id")], "at")


def test_quantiles_of_distinct_doubles_ties_and_nulls(spark):
    rng = np.random.default_rng(8)
    rows = [("a" if i % 3 else "b", float(v), bool(i % 5)) for i, v in enumerate(rng.standard_normal(3000))]
    rows += [("a", 0.25, True)] * 400 + [("a", None, True), ("c", None, True), ("c", 1.5, False), ("d", 2.0, True)]
    df = spark.createDataFrame(rows, "k string, v double, m boolean")
    parts = {"low": (F.col("m"), 0.3), "all": (F.lit(True), 0.75)}
    got = {r.k: r for r in quantiles(df, ["k"], "v", parts, {"low": "n", "all": "rows"}).collect()}
    for group in "abcd":
        for name, n, share, own in (
            ("low", "n", 0.3, [r for r in rows if r[0] == group and r[2]]),
            ("all", "rows", 0.75, [r for r in rows if r[0] == group]),
        ):
            values = [r[1] for r in own if r[1] is not None]
            assert got[group][n] == len(own)
            assert got[group][name] == (pytest.approx(np.quantile(values, share), abs=1e-12) if values else None)


def test_numbering_deals_the_rows_by_one_range_shuffle(skewed, spark):
    _, df = skewed
    numbered = ordinal(df, ["k"], [F.col("v"), F.col("id")], "n")
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    # What is left above the numbered rows joins a table of borders to them; no window is over the rows.
    assert plan.count("Window") == 1 and "_rows" in plan
    for slots in (2, 64):
        again = ordinal(df, ["k"], [F.col("v"), F.col("id")], "n", slots=slots)
        assert len(again._jdf.queryExecution().optimizedPlan().toString().splitlines()) == len(plan.splitlines())
