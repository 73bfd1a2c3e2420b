import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairmatch.functions.numeric import corrected_target
from pairmatch.operators import batches, mining

SCHEMA = (
    "id1 long, id2 long, category string, target double, surface_similarity double, "
    "identity_conflicts int, left_text string, right_text string"
)


def pairs(spark, n=300, seed=1, hot=0.7):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        category = "hot" if rng.random() < hot else rng.choice("abc")
        rows.append(
            (i, i + 1000, category, rng.randrange(10) / 9, rng.randrange(20) / 20, rng.randrange(2),
             "l" * rng.randrange(9), "r")
        )
    return spark.createDataFrame(rows, SCHEMA)


def limits(df):
    return df.withColumn("hard_negative_min_similarity", F.lit(0.7)).withColumn(
        "hard_positive_max_similarity", F.lit(0.3)
    )


def test_quotas_round_half_to_even_and_lose_nothing(spark):
    df = spark.createDataFrame([(c,) for c in "abcde"], "category string")
    got = {r.category: r.quota for r in mining.category_quotas(df, ["b", "d"], 5, 0.5).collect()}
    assert got == {"b": 1, "d": 1, "a": 1, "c": 1, "e": 1}
    got = {r.category: r.quota for r in mining.category_quotas(df, ["b", "d"], 101, 0.5).collect()}
    assert got == {"b": 25, "d": 25, "a": 17, "c": 17, "e": 17}
    with pytest.raises(ValueError):
        mining.category_quotas(df, ["b"], 5, 1.0)


def test_candidate_pool_follows_the_round_robin(spark):
    df = pairs(spark)
    quotas = spark.createDataFrame([("hot", 40), ("a", 7), ("b", 3), ("c", 1000)],
                                   "category string, quota long")
    pool = mining.candidate_pool(df, quotas, 5, short="allow").collect()
    sizes = Counter(r.category for r in pool)
    total = Counter(r.category for r in df.collect())
    assert sizes == {"hot": 40, "a": 7, "b": 3, "c": total["c"]}
    strata = Counter(r.candidate_stratum for r in pool if r.category == "hot")
    assert max(strata.values()) - min(strata.values()) <= 1
    # The kept negatives are the most similar ones.
    kept = [r.surface_similarity for r in pool if r.category == "hot" and r.candidate_stratum == 0]
    everyone = sorted(
        (r.surface_similarity for r in df.collect()
         if r.category == "hot" and r.target <= 2 / 9), reverse=True
    )
    assert sorted(kept, reverse=True) == everyone[: len(kept)]


def test_first_per_group_ignores_the_planner_threshold(spark):
    df = pairs(spark, 500)
    order = [F.col("surface_similarity"), F.col("id1")]
    small = mining.first_per_group(df, ["category"], 20, order)
    previous = spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "10")
    try:
        large = mining.first_per_group(df, ["category"], 20, order)
        assert small.exceptAll(large).count() == 0 and large.count() == small.count()
    finally:
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", previous)


def test_corrected_target(spark):
    df = spark.createDataFrame([(0.0, 1.0), (1.0, 0.0)], "o double, t double")
    got = [r.c for r in df.select(corrected_target(F.col("o"), F.col("t"), 0.75).alias("c")).collect()]
    assert got == [pytest.approx(0.75), pytest.approx(0.25)]
    with pytest.raises(ValueError):
        corrected_target(F.col("o"), F.col("t"), 1.1)


@pytest.mark.parametrize("fraction", [0.0, 0.25, 0.8])
def test_hard_replay_keeps_every_chunk_size(spark, fraction):
    chunked = batches.read_chunks(limits(pairs(spark)), 64, 3)
    sizes = Counter(r.chunk for r in chunked.collect())
    assert [sizes[c] for c in range(5)] == [64, 64, 64, 64, 44]
    out = batches.hard_replay(chunked, fraction, 3).collect()
    assert Counter(r.chunk for r in out) == sizes
    share = Counter(r.source != "base" for r in out)[True]
    assert share == sum(
        min(n - 1, max(1, round(n * fraction))) if fraction else 0 for n in sizes.values()
    )


def test_hard_replay_repeats_short_classes_and_fills_missing_ones(spark):
    rows = [(i, i + 50, "a", 1.0 if i == 0 else 0.5, 0.1, 0, "", "") for i in range(20)]
    chunked = limits(spark.createDataFrame(rows, SCHEMA)).withColumn("chunk", F.lit(0))
    out = batches.hard_replay(chunked, 0.5, 1).collect()
    got = Counter(r.source for r in out)
    # Ten replay rows: five hard ones from the single positive, five from the rest.
    assert got == {"base": 10, "hard_positive": 5, "fallback": 5}
    none = limits(pairs(spark, 20)).withColumns({"target": F.lit(0.5), "chunk": F.lit(0)})
    assert {r.source for r in batches.hard_replay(none, 0.5, 1).collect()} == {"base"}


def test_batches_are_exact_and_cover_everything(spark):
    chunked = batches.read_chunks(pairs(spark), 100, 3)
    length = F.length("left_text") + F.length("right_text")
    out = batches.batch_ids(chunked, 32, 100, length, 9).collect()
    assert len({(r.id1, r.id2) for r in out}) == len(out) == 300
    sizes = Counter(r.batch_id for r in out)
    assert [sizes[b] for b in range(10)] == [32] * 9 + [12]
    with pytest.raises(ValueError):
        batches.batch_ids(chunked, 200, 100, length, 9)


def test_mixed_replay_keeps_primary_rows_and_runs_dry_loudly(spark):
    primary, replay = pairs(spark, 70), pairs(spark, 200, 2)
    out = batches.mixed_replay(primary, replay, 32, 0.2, 1).collect()
    counts = Counter((r.batch_id, r.source) for r in out)
    assert [counts[b, "primary"] for b in range(3)] == [32, 32, 6]
    assert [counts[b, "replay"] for b in range(3)] == [8, 8, 2]
    four = batches.mixed_replay(pairs(spark, 4), replay, 4, 0.2, 1)
    assert four.where("source = 'replay'").count() == 1
    with pytest.raises(Exception, match="ends before"):
        batches.mixed_replay(primary, pairs(spark, 10), 32, 0.2, 1).collect()
    with pytest.raises(ValueError):
        batches.replay_share(F.lit(4), 0.5)


def test_swaps_move_both_sides_and_never_touch_canonical_text(spark):
    df = pairs(spark)
    out = batches.swap_pairs(df, 0.5, 7).collect()
    before = {r.id1: r for r in df.collect()}
    swapped = [r for r in out if r.swapped]
    assert 90 < len(swapped) < 210 and len(out) == 300
    for r in swapped:
        was = before[r.id2]
        assert (r.id1, r.left_text, r.right_text) == (was.id2, was.right_text, was.left_text)
    assert not batches.swap_pairs(df, 0.0, 7).where("swapped").count()
    with pytest.raises(ValueError):
        batches.swap_pairs(df, 0.5, 7, canonical_text=True)


def test_balanced_sample_is_complete(spark):
    df = pairs(spark).withColumn("source_row", F.col("id1"))
    out = mining.balanced_sample(df, 5, 2).collect()
    assert Counter(r.category for r in out) == {"hot": 5, "a": 5, "b": 5, "c": 5}
