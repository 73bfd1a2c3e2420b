"""Plans that hold at size: what goes through the driver, and over how many tasks work spreads."""

from pyspark.sql import functions as F

from pairmatch.catalogue import texts as catalogue_texts
from pairmatch.functions.evidence import item_cards
from pairmatch.functions import text
from pairmatch.operators import audits, batches, blending, graph, joins, ranking, routing, scoring
from pairmatch.operators.prompts import teacher_prompts
from pairmatch.operators.ranking import first_rows
from pairmatch.plans.ensemble import request_contract
from pairmatch.session import few_rows, settle, shuffle_width, spread, task_count

ITEM = "id long, category string, name string, attributes string"


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def items_of(spark, n=40):
    return spark.createDataFrame([(i, "c", f"n{i}", f'{{"model":"M{i}"}}') for i in range(n)], ITEM)


def test_items_are_never_sent_through_the_driver(spark):
    items = settle(items_of(spark))
    pairs = settle(spark.createDataFrame([(i, i + 1, 1.0) for i in range(30)], "id1 long, id2 long, target double"))
    cards = settle(item_cards(items))
    for joined in (
        joins.pair_cards(pairs, cards, ["identity"]),
        joins.pair_join(pairs, items),
        joins.with_category(pairs, items),
        scoring.evidence_table(pairs, items),
        scoring.evidence_table(pairs, items, "pair"),
        teacher_prompts(pairs, items),
    ):
        assert "Broadcast" not in plan(joined)
        assert joined.select("id1", "id2").distinct().count() == 30


def test_items_of_one_file_are_parsed_by_all_tasks(spark, tmp_path):
    items_of(spark, 400).coalesce(1).write.parquet(f"{tmp_path}/items")
    items = spark.read.parquet(f"{tmp_path}/items")
    for parsed in (spread(items), item_cards(items)):
        assert parsed.select(F.spark_partition_id().alias("p")).distinct().count() == shuffle_width(spark) > 1


def test_attributes_of_one_file_are_parsed_by_all_tasks(spark, tmp_path):
    rows = [(i, f"n {i}", f"Brand#{i}", "T", i) for i in range(400)]
    schema = "p_partkey long, p_name string, p_brand string, p_type string, p_size int"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    parsed = catalogue_texts._parsed(spark, str(tmp_path))
    assert parsed.select(F.spark_partition_id().alias("p")).distinct().count() == shuffle_width(spark)


def test_pair_evidence_parses_every_item_once(spark, tmp_path):
    rows = [(i, f"n {i % 3}", "Brand#1", "T", i) for i in range(40)]
    schema = "p_partkey long, p_name string, p_brand string, p_type string, p_size int"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/part.parquet")
    found = catalogue_texts.pair_evidence(spark, str(tmp_path))
    # The items were parsed before the joins, so neither side of a pair does it again.
    assert "ArrowEvalPython" not in plan(found) and found.count() > 0


def test_requests_are_checked_without_sending_items_through_the_driver(spark):
    items = settle(items_of(spark))
    pairs = settle(spark.createDataFrame([(i, i + 1) for i in range(30)], "id1 long, id2 long"))
    checked = request_contract(pairs, items)
    assert "BroadcastHashJoin" not in plan(checked)
    assert checked.first()["requested_rows"] == 30 and checked.first()["unknown_item_rows"] == 0


def test_parameters_of_few_groups_do_not_deal_rows_by_group(spark, monkeypatch):
    few = settle(spark.createDataFrame([("a", 1), ("b", 2)], "category string, quota long"))
    rows = settle(spark.range(1000).selectExpr("id", "if(id % 2 = 0, 'a', 'b') AS category"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in plan(rows.join(few_rows(few), "category"))
        assert "SortMergeJoin" in plan(rows.join(few_rows(few, 1), "category"))
        # The rows under the cuts of a group are found without a sort of whole groups.
        shown, kept = [], ranking.publish
        monkeypatch.setattr(ranking, "publish", lambda df: (shown.append(plan(df)), kept(df))[1])
        first_rows(rows, ["category"], few, [F.col("id")], "n")
        assert "BroadcastHashJoin" in shown[1] and not any("SortMergeJoin" in s for s in shown)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_chunks_spread_over_more_tasks_as_rows_grow(spark, monkeypatch):
    rows = settle(spark.range(2000).selectExpr("id AS id1", "id + 1 AS id2"))
    small = {(r.id1, r.chunk) for r in batches.read_chunks(rows, 16, 3).collect()}
    monkeypatch.setattr(batches, "task_count", lambda spark, n: task_count(spark, n, 50))
    grown = batches.read_chunks(rows, 16, 3)
    assert grown.rdd.getNumPartitions() == 40 == task_count(spark, 2000, 50)
    assert {(r.id1, r.chunk) for r in grown.collect()} == small and len(small) == 2000


def test_unknown_items_are_found_without_sorting_the_pairs(spark):
    items = spark.createDataFrame([(1,), (2,), (2,)], "id long")
    pairs = spark.createDataFrame([(1, 9), (9, 2), (None, 8), (7, None)], "id1 long, id2 long")
    found = audits.unknown_items(settle(pairs), settle(items))
    assert "Sort" not in plan(found)
    assert found.collect() == [(6, 3)]
    assert audits.unknown_items(pairs.limit(0), items).collect() == [(0, 0)]


def test_equal_rows_are_copied_once_per_candidate(spark, monkeypatch):
    rows = spark.range(600).selectExpr(
        "'c' AS category", "CAST(id % 2 AS INT) AS fold", "CAST(id % 3 = 0 AS DOUBLE) AS target", "id % 4 / 4D AS a", "id % 2 / 2D AS b"
    )
    seen, kept = [], blending.cell_precision
    monkeypatch.setattr(blending, "cell_precision", lambda cells, *rest: (seen.append(cells.count()), kept(cells, *rest))[1])
    grid = blending.weight_grid(rows, ["a", "b"], blending.simplex(2, 0.5), (0, 1))
    # Four values of (a, b), each in one fold, for three candidates.
    assert grid.where("cohort = 'all'").agg(F.sum("rows")).first()[0] == 1800 and seen == [12]


def test_routers_copy_equal_rows_once_per_state(spark, monkeypatch):
    rows = spark.range(600).selectExpr(
        "'c' AS category", "CAST(id % 2 AS INT) AS fold", "CAST(id % 3 = 0 AS DOUBLE) AS target", "id % 4 / 4D AS a", "id % 2 / 2D AS b"
    )
    seen, kept = [], routing.cell_precision
    monkeypatch.setattr(routing, "cell_precision", lambda cells, *rest: (seen.append(cells.count()), kept(cells, *rest))[1])
    routed = routing.top_k_routers(rows, (0, 1), F.col("a"), F.col("b"), routing.report_cohorts((0, 1), stress=False))
    assert routed.where("cohort = 'all'").first()["rows"] == 600 and seen[-1] == 12


def test_a_value_is_searched_for_units_once(spark):
    df = spark.createDataFrame([("5 кг",)], "v string")
    told = df.select(text.compare_plain(F.col("v")).alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert told.count("килограммов") <= 2


def test_components_are_joined_without_the_driver(spark):
    pairs = settle(spark.range(30).selectExpr("id AS id1", "id + 30 AS id2"))
    roots = graph.component_roots(pairs)
    assert "BroadcastHashJoin" not in plan(roots) and roots.count() == 60


def test_stacked_scores_are_dealt_before_they_are_grouped(spark):
    base = settle(spark.range(20).selectExpr("id AS id1", "id AS id2", "1D AS target", "'c' AS category"))
    joined = joins.validated_scores(base, {"m": base.withColumn("predict", F.lit(0.5))})
    assert "REPARTITION_BY_COL" in plan(joined) and joined.count() == 20
