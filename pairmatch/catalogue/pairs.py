"""Joins, pair tables, summaries, set operations and scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairmatch.catalogue.quality import _SIMILARITY_SQL
from pairmatch.catalogue.registry import hash_sql, query, real, whole
from pairmatch.functions.numeric import majority_positive, target_stratum, unanimous
from pairmatch.operators import joins, splits, summaries
from pairmatch.plans.pair_tables import PairTableConfig, manifest, pair_tables
from pairmatch.session import settle
from pairmatch.sources import tables, views

CONFIG = PairTableConfig(sample_seed=2026)

_JOINED_SQL = """SELECT p.id1, p.id2, p.target, a.category, b.category AS right_category,
  a.name AS left_name, b.name AS right_name,
  a.attributes AS left_attributes, b.attributes AS right_attributes
  FROM {pairs} p JOIN items a ON a.id = p.id1 JOIN items b ON b.id = p.id2"""


@query(views.with_views(["human_pairs"], query=_JOINED_SQL.format(pairs="human_pairs")))
def pair_join(spark, sf_dir):
    return joins.pair_join(views.human_pairs(spark, sf_dir), views.items(spark, sf_dir))


@query(
    views.with_views(
        ["items", "scored"],
        query="""SELECT s.id1, s.id2, i.category, i.name FROM scored s
        LEFT JOIN items i ON i.id = s.id1""",
    )
)
def lookup_join(spark, sf_dir):
    """Left lookup that keeps unknown items with null fields."""
    scored = views.scored(spark, sf_dir).select("id1", "id2")
    cards = views.items(spark, sf_dir).select(F.col("id").alias("id1"), "category", "name")
    return scored.join(cards, "id1", "left").select("id1", "id2", "category", "name")


@query(
    views.with_views(
        ["soft_pairs"],
        query=f"""SELECT p.id1, p.id2, {real('p.target', 'target')}, i.category FROM soft_pairs p LEFT JOIN items i ON i.id = p.id1""",
    )
)
def pair_category(spark, sf_dir):
    return joins.with_category(views.soft_pairs(spark, sf_dir), views.items(spark, sf_dir))


@query(
    views.with_views(
        ["scored"],
        f"""a AS (SELECT id1, id2, target, category, fold, {real('score_a', 'base')} FROM scored)""",
        f"b AS (SELECT id1, id2, {real('score_b', 'small')} FROM scored)",
        query="SELECT a.*, b.small FROM a LEFT JOIN b USING (id1, id2)",
    )
)
def join_scores(spark, sf_dir):
    scored = views.scored(spark, sf_dir)
    base = scored.select("id1", "id2", "target", "category", "fold", F.col("score_a").alias("base"))
    small = scored.select("id1", "id2", F.col("score_b").alias("predict"))
    return joins.join_scores(base, {"small": small})


def _similar_sql(pairs: str) -> str:
    return f"""named AS (SELECT p.id1, p.id2, p.target, a.category, b.category AS right_category,
  a.name AS left_name, b.name AS right_name,
  lower(coalesce(a.name, '')) AS ln, lower(coalesce(b.name, '')) AS rn
  FROM {pairs} p JOIN items a ON a.id = p.id1 JOIN items b ON b.id = p.id2),
alike AS (SELECT id1, id2, target, category, right_category, left_name, right_name,
  {_SIMILARITY_SQL} AS surface_similarity FROM named)"""


@query(
    views.with_views(
        ["human_pairs"],
        _similar_sql("human_pairs"),
        query=f"SELECT id1, id2, {real('surface_similarity', 'surface_similarity')} FROM alike",
    )
)
def surface_similarity(spark, sf_dir):
    joined = joins.pair_join(
        views.human_pairs(spark, sf_dir), views.items(spark, sf_dir), ["name"]
    )
    return joins.with_surface_similarity(joined).select("id1", "id2", "surface_similarity")


_LEFT, _RIGHT = (f"({hash_sql(None, side)} % 5 = 0)" for side in ("id1", "id2"))
SPLIT_SQL = f"""CASE WHEN {_LEFT} AND {_RIGHT} THEN 'validation'
  WHEN NOT {_LEFT} AND NOT {_RIGHT} THEN 'train' ELSE 'dropped_cross' END"""
_DATASETS_SQL = f"""dataset_pairs AS (
  SELECT 'soft_train' AS dataset, id1, id2, target FROM soft_pairs
  WHERE {SPLIT_SQL} = 'train'
  UNION ALL SELECT 'soft_validation', id1, id2, target FROM soft_pairs
  WHERE {SPLIT_SQL} = 'validation'
  UNION ALL SELECT 'human_all', id1, id2, target FROM human_pairs)"""
_BUILT_SQL = f"""built_named AS (SELECT p.dataset, p.id1, p.id2, p.target, a.category,
  b.category AS right_category, a.name AS left_name, b.name AS right_name,
  lower(coalesce(a.name, '')) AS ln, lower(coalesce(b.name, '')) AS rn
  FROM dataset_pairs p JOIN items a ON a.id = p.id1 JOIN items b ON b.id = p.id2),
built AS (SELECT dataset, id1, id2, target, category, right_category, left_name, right_name,
  {_SIMILARITY_SQL} AS surface_similarity FROM built_named)"""


def _built(spark, sf_dir):
    cards = views.items(spark, sf_dir)
    human = views.human_pairs(spark, sf_dir)
    folds = human.withColumns({"component_id": F.lit(0), "fold": F.lit(0)})
    return pair_tables(views.soft_pairs(spark, sf_dir), cards, folds, cards, CONFIG)


@query(
    views.with_views(
        ["human_pairs", "soft_pairs"],
        _DATASETS_SQL,
        _BUILT_SQL,
        query=f"""SELECT dataset, id1, id2, {real('target', 'target')}, category, left_name,
        right_name, {real('surface_similarity', 'surface_similarity')} FROM built""",
    )
)
def pair_text_build(spark, sf_dir):
    parts = [
        table.select(
            F.lit(name).alias("dataset"), "id1", "id2", "target", "category",
            "left_name", "right_name", "surface_similarity",
        )
        for name, table in _built(spark, sf_dir).items()
    ]
    return summaries.stack(parts)


def _metric(expression: str, name: str) -> str:
    return f"SELECT dataset, '{name}' AS metric, CAST({expression} AS DOUBLE) AS value FROM built GROUP BY dataset"


_MANIFEST_SQL = " UNION ALL ".join(
    [
        _metric("count(*)", "rows"),
        _metric("count(DISTINCT id1)", "unique_left_items"),
        _metric("count(DISTINCT id2)", "unique_right_items"),
        _metric("avg(target)", "mean_target"),
        _metric("count(*) FILTER (WHERE target >= CAST(5 AS DOUBLE) / 9)", "majority_positive_rows"),
        _metric(
            "count(*) FILTER (WHERE category IS NULL OR left_name IS NULL OR right_name IS NULL)",
            "required_null_rows",
        ),
        _metric(
            "count(*) FILTER (WHERE category IS DISTINCT FROM right_category)",
            "category_mismatch_rows",
        ),
        _metric("min(surface_similarity)", "min_surface_similarity"),
        _metric("avg(surface_similarity)", "mean_surface_similarity"),
        _metric("max(surface_similarity)", "max_surface_similarity"),
        _metric(
            "count(*) FILTER (WHERE NOT (surface_similarity BETWEEN 0 AND 1))",
            "invalid_surface_similarity_rows",
        ),
        f"""SELECT 'soft_source', 'rows_' || {SPLIT_SQL}, CAST(count(*) AS DOUBLE)
        FROM soft_pairs GROUP BY 2""",
        """SELECT 'item_overlap', 'first_items', CAST(count(*) AS DOUBLE) FROM soft_items""",
        """SELECT 'item_overlap', 'second_items', CAST(count(*) AS DOUBLE) FROM human_items""",
        """SELECT 'item_overlap', 'shared_items', CAST(count(*) AS DOUBLE)
        FROM soft_items JOIN human_items USING (id)""",
    ]
)
_ITEMS_SQL = (
    "soft_items AS (SELECT id1 AS id FROM soft_pairs UNION SELECT id2 FROM soft_pairs)",
    "human_items AS (SELECT id1 AS id FROM human_pairs UNION SELECT id2 FROM human_pairs)",
)


@query(
    views.with_views(
        ["human_pairs", "soft_pairs"],
        _DATASETS_SQL,
        _BUILT_SQL,
        *_ITEMS_SQL,
        query=f"SELECT dataset, metric, round(value, 9) + 0 AS value FROM ({_MANIFEST_SQL})",
    )
)
def pair_table_manifest(spark, sf_dir):
    built = {name: settle(table) for name, table in _built(spark, sf_dir).items()}
    return manifest(
        built, views.soft_pairs(spark, sf_dir), views.human_pairs(spark, sf_dir), CONFIG
    )


@query(
    views.with_views(
        ["soft_pairs"],
        _similar_sql("soft_pairs"),
        query=f"""SELECT count(*) AS rows, count(DISTINCT id1) AS unique_left_items,
        count(DISTINCT id2) AS unique_right_items, {real('avg(target)', 'mean_target')},
        count(*) FILTER (WHERE target >= CAST(5 AS DOUBLE) / 9) AS majority_positive_rows,
        count(*) FILTER (WHERE category IS NULL OR left_name IS NULL OR right_name IS NULL)
          AS required_null_rows,
        count(*) FILTER (WHERE category IS DISTINCT FROM right_category) AS category_mismatch_rows,
        {real('min(surface_similarity)', 'min_surface_similarity')},
        {real('avg(CAST(surface_similarity AS DOUBLE))', 'mean_surface_similarity')},
        {real('max(surface_similarity)', 'max_surface_similarity')},
        count(*) FILTER (WHERE NOT (surface_similarity BETWEEN 0 AND 1))
          AS invalid_surface_similarity_rows FROM alike""",
    )
)
def dataset_summary(spark, sf_dir):
    joined = joins.pair_join(views.soft_pairs(spark, sf_dir), views.items(spark, sf_dir), ["name"])
    return summaries.dataset_summary(joins.with_surface_similarity(joined))


@query(
    views.with_views(
        ["soft_pairs"],
        query=f"""SELECT i.category, count(*) AS rows, {real('avg(p.target)', 'mean_target')},
        count(*) FILTER (WHERE p.target >= CAST(5 AS DOUBLE) / 9) AS majority_positive_rows
        FROM soft_pairs p JOIN items i ON i.id = p.id1 GROUP BY i.category""",
    )
)
def category_summary(spark, sf_dir):
    return summaries.category_summary(
        joins.with_category(views.soft_pairs(spark, sf_dir), views.items(spark, sf_dir))
    )


@query(
    views.with_views(
        ["scored"],
        query=f"""SELECT fold, category, count(*) AS rows, {whole('sum(target)', 'positives')},
        {real('avg(target)', 'positive_rate')}, count(DISTINCT id1) AS components
        FROM scored GROUP BY GROUPING SETS ((fold, category), (fold))""",
    )
)
def fold_summary(spark, sf_dir):
    """The order id stands in for the component: rows of one order share a fold."""
    return summaries.fold_summary(
        views.scored(spark, sf_dir).withColumn("component_id", F.col("id1"))
    )


@query(
    views.with_views(
        ["soft_pairs"],
        query=f"SELECT {SPLIT_SQL} AS split, count(*) AS rows FROM soft_pairs GROUP BY 1",
    )
)
def split_counts(spark, sf_dir):
    soft = views.soft_pairs(spark, sf_dir)
    return soft.groupBy(splits.hash_split().alias("split")).agg(F.count(F.lit(1)).alias("rows"))


@query(
    views.with_views(
        ["human_pairs", "soft_pairs"],
        *_ITEMS_SQL,
        query="""SELECT (SELECT count(*) FROM human_items) AS first_items,
        (SELECT count(*) FROM soft_items) AS second_items,
        (SELECT count(*) FROM human_items JOIN soft_items USING (id)) AS shared_items""",
    )
)
def item_overlap(spark, sf_dir):
    return summaries.item_overlap(views.human_pairs(spark, sf_dir), views.soft_pairs(spark, sf_dir))


@query(views.with_views(["soft_pairs"], *_ITEMS_SQL[:1], query="SELECT id FROM soft_items"))
def item_ids(spark, sf_dir):
    return summaries.item_ids(views.soft_pairs(spark, sf_dir))


@query(
    views.with_views(
        ["scored"],
        query=f"""SELECT count(*) AS rows, count(DISTINCT (id1, id2)) AS unique_pairs,
        {real('min(soft_target)', 'target_min')}, {real('max(soft_target)', 'target_max')},
        count(DISTINCT category) AS categories FROM scored""",
    )
)
def rollup_audit(spark, sf_dir):
    return summaries.rollup_audit(views.scored(spark, sf_dir), "soft_target")


def _fold_columns(spark, sf_dir):
    return views.scored(spark, sf_dir).select(
        "id1", "id2", "target", "category", "fold", F.col("score_a").alias("predict")
    )


@query(
    views.with_views(
        ["scored"],
        query=f"SELECT id1, id2, target, category, fold, {real('score_a', 'predict')} FROM scored",
    )
)
def fold_union(spark, sf_dir):
    """Per-fold tables stacked again, each tagged with its fold."""
    whole_table = _fold_columns(spark, sf_dir)
    parts = {
        fold: whole_table.where(F.col("fold") == fold).drop("fold") for fold in range(5)
    }
    return tables.union_folds(parts)


@query(
    views.with_views(
        ["scored"],
        """nested AS (SELECT *, id1 % 3 AS inner_fold FROM scored)""",
        query="""SELECT 'include' AS filter, count(*) AS rows FROM nested WHERE fold = 1
        UNION ALL SELECT 'exclude', count(*) FROM nested WHERE fold <> 1
        UNION ALL SELECT 'nested', count(*) FROM nested WHERE fold <> 1 AND inner_fold = 2
        UNION ALL SELECT 'category', count(*) FROM nested WHERE category IN ('AF', 'RO')""",
    )
)
def fold_filter(spark, sf_dir):
    nested = views.scored(spark, sf_dir).withColumn("inner_fold", F.col("id1") % 3)
    kept = {
        "include": tables.fold_filter(nested, include_fold=1),
        "exclude": tables.fold_filter(nested, exclude_fold=1),
        "nested": tables.fold_filter(nested, exclude_fold=1, include_inner_fold=2),
        "category": nested.where(F.col("category").isin("AF", "RO")),
    }
    return summaries.stack(
        [
            df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("filter"), "rows")
            for name, df in kept.items()
        ]
    )


@query(
    views.with_views(
        ["scored"],
        query="""SELECT CASE WHEN soft_target <= CAST(2 AS DOUBLE) / 9 THEN 0
          WHEN soft_target >= CAST(7 AS DOUBLE) / 9 THEN 1 ELSE 2 END AS stratum,
        count(*) AS rows, count(*) FILTER (WHERE soft_target >= CAST(5 AS DOUBLE) / 9) AS majority,
        count(*) FILTER (WHERE soft_target IN (0, 1)) AS unanimous FROM scored GROUP BY 1""",
    )
)
def label_strata(spark, sf_dir):
    soft = F.col("soft_target")
    return views.scored(spark, sf_dir).groupBy(target_stratum(soft).alias("stratum")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(majority_positive(soft)).alias("majority"),
        F.count_if(unanimous(soft)).alias("unanimous"),
    )
