import collections
import hashlib
import math
import zlib

import pytest
from pyspark.sql import functions as F

from pairmatch.llm.sharding import EIGHT, NINE, place, shard_rows, tree


def slow_place(node, key):
    """The descent in plain Python."""
    while node.children:
        best, chosen = None, None
        for child in node.children:
            if child.weight <= 0:
                continue
            u = (int(hashlib.md5(f"{child.name}|{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            draw = math.log(u) / child.weight
            if best is None or draw > best:
                best, chosen = draw, child
        node = chosen
    return node.shard


def placed(spark, regions, n=3000):
    ids = spark.range(n).select(F.col("id").cast("string").alias("k"))
    return {r["k"]: r["s"] for r in ids.select("k", place(tree(regions), F.col("k")).alias("s")).collect()}


def test_descent_equals_plain_python(spark):
    regions = [[[1.0, 2.0], [0.5]], [[3.0], [0.0, 1.0]]]
    for key, shard in placed(spark, regions, 500).items():
        assert shard == slow_place(tree(regions), key)


def test_rows_follow_the_weights(spark):
    counts = collections.Counter(placed(spark, [[[1.0, 3.0]], [[4.0]]], 8000).values())
    assert abs(counts[0] / 8000 - 0.125) < 0.02 and abs(counts[1] / 8000 - 0.375) < 0.03


def test_changes_stay_in_the_subtrees_whose_weights_change(spark):
    before = placed(spark, EIGHT)
    grown = placed(spark, NINE)
    assert all(grown[k] in (before[k], 8) for k in before)
    assert 0.06 < sum(v == 8 for v in grown.values()) / len(grown) < 0.16
    heavier = placed(spark, [[[2.0, 1.0], [1.0, 1.0]], EIGHT[1]])
    # A heavier shard draws rows into its region; nothing moves between the others' regions.
    assert all((before[k] < 4) == (heavier[k] < 4) or heavier[k] < 4 for k in before)
    moved_inside = [k for k in before if before[k] in (4, 5, 6, 7) and heavier[k] in (4, 5, 6, 7)]
    assert all(before[k] == heavier[k] for k in moved_inside)


def test_slots_are_gapless_for_nulls_repeats_and_extra_columns(spark):
    rows = [(i, "x" * (i % 5)) for i in range(400)] + [(7, "again"), (7, "again"), (None, None), (None, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_slice", F.lit(1))
    got = shard_rows(df, "doc_id", tree(EIGHT), tree(NINE), ["text"]).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "text", "_slice", "shard", "slot", "grown_shard"}
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(slots) == list(range(len(slots))) for slots in by.values())
    assert len({r.shard for r in got if r.doc_id == 7}) == 1 and len({r.shard for r in got if r.doc_id is None}) == 1


def test_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert shard_rows(empty, "doc_id", tree(EIGHT)).count() == 0
    with pytest.raises(ValueError):
        shard_rows(empty.withColumn("Slot", F.lit(1)), "doc_id", tree(EIGHT))
    with pytest.raises(ValueError):
        tree([[[0.0]]])


def test_query_digests(spark, tmp_path):
    from pairmatch.llm.sharding import op1_hash_tree

    rows = [(1, "é"), (2, None), (3, ""), (3, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.size, r.text_crc32, r.law) for r in op1_hash_tree(spark, str(tmp_path)).collect())
    assert got == [(1, 3, zlib.crc32("é".encode()), "key"), (2, 1, 0, "key"), (3, 1, 0, "key"), (3, 1, 0, "key")]
