"""Stored layouts: buckets, footers, fold folders, ordered files, and contracts of stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairmatch.catalogue.registry import (
    THRESHOLDS_SQL,
    average_rank_sql,
    hash_sql,
    precision_sql,
    query,
    real,
    spearman_sql,
    whole,
)
from pairmatch.functions.hashing import seeded_hash
from pairmatch.operators import audits, joins, summaries
from pairmatch.operators.blending import blend_scores, rank_residual
from pairmatch.operators.metrics import average_precision, macro
from pairmatch.operators.routing import Residual, check_record, output_order, shipped_parity
from pairmatch.session import publish, settle
from pairmatch.sources import layouts, tables, views


@query(
    views.with_views(
        ["human_pairs"],
        query=f"""SELECT p.id1, p.id2, {real('p.target', 'target')}, a.category, a.name AS left_name,
        b.name AS right_name, a.attributes AS left_attributes, b.attributes AS right_attributes
        FROM human_pairs p JOIN items a ON a.id = p.id1 JOIN items b ON b.id = p.id2""",
    )
)
def bucketed_pair_join(spark, sf_dir):
    """Both items of each pair from an item table in buckets, which no join moves."""
    items = layouts.write_bucketed(views.items(spark, sf_dir), "id")
    return layouts.bucketed_pair_join(views.human_pairs(spark, sf_dir), items, ["name", "attributes"])


@query(
    """SELECT count(*) AS rows, min(l_orderkey) AS min_l_orderkey, max(l_orderkey) AS max_l_orderkey,
    min(l_linenumber) AS min_l_linenumber, max(l_linenumber) AS max_l_linenumber FROM lineitem"""
)
def footer_counts(spark, sf_dir):
    """Rows and value ranges of a table from its footers."""
    return layouts.footer_summary(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_linenumber"])


@query(
    views.with_views(
        ["scored"],
        "sizes AS (SELECT fold FROM scored GROUP BY fold HAVING count(*) % 3 <> 0 OR fold = 1)",
        query=f"""SELECT fold, category, count(*) AS rows, {real('sum(score_a)', 'score_a')}
        FROM scored WHERE fold IN (SELECT fold FROM sizes) GROUP BY fold, category""",
    )
)
def pruned_folds(spark, sf_dir):
    """Sums over the folds that a table picks at run time; the folders of the others stay closed."""
    scored = views.scored(spark, sf_dir).select("id1", "id2", "category", "score_a", "fold")
    path = layouts.new_path(spark, "folds")
    layouts.write_folds(scored, path)
    sizes = scored.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
    picked = sizes.where((F.col("n") % 3 != 0) | (F.col("fold") == 1))
    chosen = layouts.read_selected_folds(spark, path, picked)
    return chosen.groupBy("fold", "category").agg(F.count(F.lit(1)).alias("rows"), F.sum("score_a").alias("score_a"))


_BROKEN_SQL = """broken AS (SELECT CASE WHEN fold = 3 AND id1 % 7 = 3 THEN NULL ELSE id1 END AS id1, id2, fold,
  CASE WHEN fold = 1 AND id1 % 4 = 1 THEN CAST('NaN' AS DOUBLE) WHEN fold = 1 AND id1 % 4 = 2 THEN NULL ELSE score_a END AS score
  FROM scored UNION ALL SELECT id1, id2, fold, score_a FROM scored WHERE fold = 2 AND id1 % 5 = 2)"""


@query(
    views.with_views(
        ["scored"],
        _BROKEN_SQL,
        """per_key AS (SELECT fold, id1, id2, count(*) AS n, count(*) FILTER (WHERE score IS NULL OR isnan(score)) AS missing
        FROM broken GROUP BY fold, id1, id2)""",
        query=f"""SELECT *, null_keys + missing_scores + repeated_keys = 0 AS valid FROM (SELECT fold,
        {whole('sum(n)', 'rows')}, {whole('sum(CASE WHEN id1 IS NULL THEN n ELSE 0 END)', 'null_keys')},
        {whole('sum(missing)', 'missing_scores')},
        {whole('sum(CASE WHEN id1 IS NULL THEN 0 ELSE n - 1 END)', 'repeated_keys')} FROM per_key GROUP BY fold)""",
    )
)
def fold_contract(spark, sf_dir):
    """Three folds with planted defects, two without."""
    scored = views.scored(spark, sf_dir)
    broken = scored.selectExpr(
        "CASE WHEN fold = 3 AND id1 % 7 = 3 THEN NULL ELSE id1 END AS id1", "id2", "fold",
        "CASE WHEN fold = 1 AND id1 % 4 = 1 THEN double('NaN') WHEN fold = 1 AND id1 % 4 = 2 THEN NULL ELSE score_a END AS score",
    )
    again = scored.where("fold = 2 AND id1 % 5 = 2").selectExpr("id1", "id2", "fold", "score_a AS score")
    return layouts.fold_contract(broken.unionByName(again), ["score"])


@query(
    views.with_views(
        ["scored"],
        query=f"""SELECT row_number() OVER (ORDER BY {hash_sql(5, 'id1', 'id2')}, id1, id2) - 1 AS row, id1, id2,
        {real('score_b', 'predict')} FROM scored""",
    )
)
def ordered_predictions(spark, sf_dir):
    """Predictions that come in any order, written over several files in the request's, and read back."""
    scored = views.scored(spark, sf_dir)
    request = layouts.numbered_request(
        scored.select("id1", "id2"), [seeded_hash(5, "id1", "id2"), F.col("id1"), F.col("id2")]
    )
    scores = scored.select("id1", "id2", F.col("score_b").alias("predict"))
    path = layouts.new_path(spark, "predictions")
    layouts.write_ordered(request.join(scores, ["id1", "id2"]), path)
    return layouts.read_ordered(spark, path, "id1 long, id2 long, predict double").select("row", "id1", "id2", "predict")


@query(
    views.with_views(
        ["scored"],
        query=f"""SELECT row_number() OVER (ORDER BY fold, id1, id2) - 1 AS row, id1, id2,
        {real('score_a', 'predict')} FROM scored""",
    )
)
def finished_table(spark, sf_dir):
    """A finished table in its stable order, over several files, read back with the places."""
    scored = views.scored(spark, sf_dir).select("id1", "id2", "fold", F.col("score_a").alias("predict"))
    path = layouts.new_path(spark, "finished")
    layouts.write_ordered(layouts.numbered_request(scored, output_order(scored)), path)
    return layouts.read_ordered(spark, path, "id1 long, id2 long, predict double").select("row", "id1", "id2", "predict")


@query(
    views.with_views(
        ["scored"],
        THRESHOLDS_SQL,
        query=f"""SELECT category, {real('any_value(hard_negative_min_similarity)', 'low')},
        count(*) FILTER (WHERE target <= 0.2 AND surface_similarity >= hard_negative_min_similarity) AS hard_negatives,
        count(*) FILTER (WHERE target >= 0.8 AND surface_similarity <= hard_positive_max_similarity) AS hard_positives
        FROM stressed GROUP BY category""",
    )
)
def thresholds_from_file(spark, sf_dir):
    """Thresholds written as a file of records, read back, and joined to the rows."""
    scored = views.scored(spark, sf_dir)
    path = layouts.new_path(spark, "thresholds")
    tables.write_records(summaries.hard_pair_thresholds(scored), path)
    names = ["hard_negative_min_similarity", "hard_positive_max_similarity"]
    rows = joins.with_category_parameters(scored, tables.read_thresholds(spark, path), names)
    low, high, similar = F.col(names[0]), F.col(names[1]), F.col("surface_similarity")
    return rows.groupBy("category").agg(
        F.any_value(low).alias("low"),
        F.count_if((F.col("target") <= 0.2) & (similar >= low)).alias("hard_negatives"),
        F.count_if((F.col("target") >= 0.8) & (similar <= high)).alias("hard_positives"),
    )


_LEARNT = "0.25 + (count(*) % 4) / CAST(8 AS DOUBLE)"


@query(
    views.with_views(
        ["scored"],
        f"learnt AS (SELECT category, {_LEARNT} AS a FROM scored GROUP BY category)",
        query=f"""SELECT id1, id2, category, {real('a * score_a + (1 - a) * score_b', 'predict')}
        FROM scored JOIN learnt USING (category)""",
    )
)
def weights_from_file(spark, sf_dir):
    """Weights per category written as a file of records, read back and applied."""
    scored = views.scored(spark, sf_dir)
    path = layouts.new_path(spark, "weights")
    share = F.lit(0.25) + (F.count(F.lit(1)) % 4) / F.lit(8.0)
    learnt = scored.groupBy("category").agg(share.alias("a"))
    tables.write_records(learnt.select("category", F.array("a", 1 - F.col("a")).alias("weights")), path)
    blended = blend_scores(scored, ["score_a", "score_b"], tables.read_weights(spark, path))
    return blended.select("id1", "id2", "category", "predict")


@query(
    views.with_views(
        ["scored"],
        query=f"""SELECT category, fold, count(*) AS rows, {real('max(score_a)', 'highest')}
        FROM scored WHERE fold <> 2 GROUP BY category, fold""",
    )
)
def stored_table(spark, sf_dir):
    """A partitioned table written in small row groups and read back by two of its columns and a fold filter."""
    path = layouts.new_path(spark, "stored")
    tables.write_parquet(views.scored(spark, sf_dir), path, ["fold"], row_group_bytes=1 << 20)
    rows = tables.fold_filter(tables.read_folds(spark, path, ["category", "score_a"]), exclude_fold=2)
    return rows.groupBy("category", F.col("fold").cast("int").alias("fold")).agg(
        F.count(F.lit(1)).alias("rows"), F.max("score_a").alias("highest")
    )


_ROUTED = "CASE WHEN category IN ('AF', 'RF') AND fold <> 3 THEN 0.55 * score_a + 0.45 * score_b ELSE score_a END"
_OTHER = _ROUTED.replace("fold <> 3", "fold <> 4")


@query(
    views.with_views(
        ["scored"],
        f"rebuilt AS (SELECT *, {_ROUTED} AS predict FROM scored), other AS (SELECT *, {_OTHER} AS predict FROM scored)",
        precision_sql("rebuilt", ["category"], "predict", {"all": "true"}, out="a"),
        precision_sql("other", ["category"], "predict", {"all": "true"}, out="b"),
        """kept AS (SELECT (SELECT avg(average_precision) FROM a) AS m, (SELECT avg(average_precision) FROM b) AS o),
records AS (SELECT 'kept' AS record, m AS metric, m AS rebuilt FROM kept UNION ALL SELECT 'moved', m + 1e-6, m FROM kept
  UNION ALL SELECT 'other route', o, m FROM kept)""",
        query=f"""SELECT record, {real('metric', 'metric')}, {real('rebuilt', 'rebuilt')},
        abs(metric - rebuilt) <= 1e-9 AS matches FROM records""",
    )
)
def recorded_routes(spark, sf_dir):
    """A stored record of three routes: one as rebuilt, one with its metric moved, one of another selection."""
    scored = views.scored(spark, sf_dir)
    rebuilt = settle(scored.withColumn("predict", F.expr(_ROUTED)))
    other = scored.withColumn("predict", F.expr(_OTHER))
    metric = [
        macro(average_precision(df, ["category"], "predict")).select(F.col("macro_average_precision").alias("metric"))
        for df in (rebuilt, other)
    ]
    records = (
        metric[0].select(F.lit("kept").alias("record"), "metric")
        .unionByName(metric[0].select(F.lit("moved").alias("record"), (F.col("metric") + 1e-6).alias("metric")))
        .unionByName(metric[1].select(F.lit("other route").alias("record"), "metric"))
    )
    path = layouts.new_path(spark, "records")
    tables.write_records(records, path)
    return check_record(rebuilt, tables.read_records(spark, path, "record string, metric double"), 1e-9)


_RESIDUAL = Residual("teacher", ("AF", "RF"), 0.7, 0.3)
_RANK = "(({rank}) / (count(*) OVER (PARTITION BY category) + CAST(1 AS DOUBLE)))"
_EXPECTED_SQL = f"""blended AS (SELECT *, 0.6 * score_a + 0.4 * score_b AS blend FROM scored),
expected AS (SELECT *, CASE WHEN category IN ('AF', 'RF') THEN
  0.7 * {_RANK.format(rank=average_rank_sql(['category'], 'blend'))}
  + 0.3 * {_RANK.format(rank=average_rank_sql(['category'], 'score_c'))} ELSE blend END AS expected FROM blended),
actual AS (SELECT *, CAST(CAST(expected AS FLOAT) AS DOUBLE) AS single,
  expected + CASE WHEN category = 'AF' AND id1 % 4 = 1 THEN 0.2 ELSE 0 END AS moved, 1 AS one FROM expected)"""


def _parity_sql(name: str, column: str) -> str:
    return f"""SELECT '{name}' AS shipment, count(*) AS rows, {real(f'max(abs({column} - expected))', 'max_abs_delta')},
    {real(f'avg(abs({column} - expected))', 'mean_abs_delta')},
    (SELECT round(spearman, 9) FROM {column}_all) AS global_spearman,
    (SELECT round(min(spearman), 9) FROM {column}_each) AS minimum_category_spearman,
    max(abs({column} - expected)) <= 0.125 AND avg(abs({column} - expected)) <= 0.01
      AND (SELECT min(spearman) FROM {column}_each) >= 0.9999 AS passed FROM actual"""


@query(
    views.with_views(
        ["scored"],
        _EXPECTED_SQL,
        *[
            spearman_sql("actual", keys, column, "expected", f"{column}_{out}")
            for column in ("single", "moved")
            for keys, out in ((["one"], "all"), (["category"], "each"))
        ],
        query=_parity_sql("as computed", "single") + " UNION ALL " + _parity_sql("moved", "moved"),
    )
)
def shipped_tables(spark, sf_dir):
    """Two shipped tables against their components: one in single precision, one with scores moved in one category."""
    # Every table below reads a column or two of it.
    scored = publish(views.scored(spark, sf_dir).select("id1", "id2", "category", "score_a", "score_b", "score_c"))
    parts = {
        name: scored.select("id1", "id2", F.col(column).alias("predict"))
        for name, column in (("large", "score_a"), ("small", "score_b"), ("teacher", "score_c"))
    }
    blend = scored.withColumn("blend", 0.6 * F.col("score_a") + 0.4 * F.col("score_b"))
    right = rank_residual(blend, "blend", "score_c", _RESIDUAL.categories, 0.7, 0.3).select("id1", "id2", "category", "predict")
    right = settle(right)
    shift = F.when((F.col("category") == "AF") & (F.col("id1") % 4 == 1), 0.2).otherwise(0.0)
    shipped = {
        "as computed": right.withColumn("predict", F.col("predict").cast("float").cast("double")),
        "moved": right.withColumn("predict", F.col("predict") + shift),
    }
    rows = [
        shipped_parity(table, scored, parts, (0.6, 0.4), _RESIDUAL).select(F.lit(name).alias("shipment"), "*")
        for name, table in shipped.items()
    ]
    return rows[0].unionByName(rows[1])


_WIDTH = 64
_CONTRACT_SQL = """contract AS (SELECT p_partkey, CASE WHEN p_partkey % 97 = 5 THEN p_name || ' x' ELSE p_name END AS p_name, p_size
  FROM part WHERE p_partkey % 211 <> 7
  UNION ALL SELECT -p_partkey, p_name, p_size FROM part WHERE p_partkey % 503 = 9)"""


def _contract(spark, sf_dir):
    """The part table as a contract once had it: some names, rows and keys are others."""
    part = views.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    kept = part.where("p_partkey % 211 <> 7").withColumn(
        "p_name", F.when(F.col("p_partkey") % 97 == 5, F.concat("p_name", F.lit(" x"))).otherwise(F.col("p_name"))
    )
    added = part.where("p_partkey % 503 = 9").withColumn("p_partkey", -F.col("p_partkey"))
    return part, kept.unionByName(added)


def _range_sql(source: str) -> str:
    value = hash_sql(None, "p_partkey", "p_name", "p_size")
    return f"""SELECT CAST(floor(p_partkey / {_WIDTH}.0) AS BIGINT) AS bucket, count(*) AS rows,
    bit_xor({value}) AS x, sum(CAST({value} AS HUGEINT)) AS s FROM {source} GROUP BY 1"""


@query(
    f"""WITH {_CONTRACT_SQL}, found AS ({_range_sql('part')}), kept AS ({_range_sql('contract')})
    SELECT coalesce(f.bucket, k.bucket) AS bucket, coalesce(f.rows, 0) AS rows, coalesce(k.rows, 0) AS contract_rows,
    f.rows IS NOT DISTINCT FROM k.rows AND f.x IS NOT DISTINCT FROM k.x AND f.s IS NOT DISTINCT FROM k.s AS verified
    FROM found f FULL JOIN kept k ON f.bucket = k.bucket"""
)
def lineage_ranges(spark, sf_dir):
    """Every range of a table against its contract: true where nothing was planted, false elsewhere."""
    part, contract = _contract(spark, sf_dir)
    prints = [audits.range_prints(df, "p_partkey", ["p_name", "p_size"], _WIDTH, "md5") for df in (part, contract)]
    return audits.compare_prints(*prints)


@query(
    f"""WITH {_CONTRACT_SQL}
    SELECT coalesce(f.p_partkey, c.p_partkey) AS p_partkey,
    CASE WHEN f.p_partkey IS NULL THEN 'missing' WHEN c.p_partkey IS NULL THEN 'unexpected' ELSE 'changed' END AS difference
    FROM part f FULL JOIN contract c ON f.p_partkey = c.p_partkey
    WHERE f.p_partkey IS NULL OR c.p_partkey IS NULL OR f.p_name <> c.p_name OR f.p_size <> c.p_size"""
)
def lineage_differences(spark, sf_dir):
    """The rows behind the ranges that differ, named by a second pass over those ranges alone."""
    part, contract = _contract(spark, sf_dir)
    return audits.differing_rows(part, contract, "p_partkey", ["p_name", "p_size"], _WIDTH, "md5")


@query(
    views.with_views(
        ["scored"],
        query=f"""SELECT id1, id2, category, {real('target', 'target')}, {real('score_a', 'large')},
        {real('score_b', 'small')} FROM scored""",
    )
)
def validated_scores(spark, sf_dir):
    """Two models' scores under the contract of the join; one table's targets are off by less than it allows."""
    scored = views.scored(spark, sf_dir)
    base = scored.select("id1", "id2", "category", "target")
    large = scored.selectExpr("id1", "id2", "target + 5e-8 AS target", "score_a AS predict")
    small = scored.selectExpr("id1", "id2", "target", "score_b AS predict").repartition(5)
    return joins.validated_scores(base, {"large": large, "small": small})
