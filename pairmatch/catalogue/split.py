"""Hash splits, shards, shuffles, components and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairmatch.catalogue.pairs import SPLIT_SQL
from pairmatch.catalogue.registry import hash_sql, query, real, whole
from pairmatch.operators import audits, splits, summaries
from pairmatch.operators.graph import component_ids
from pairmatch.operators.joins import with_category
from pairmatch.session import settle
from pairmatch.sources import tables, views

SEED, INNER_SEED, K = 2026, 77, 5


@query(
    views.with_views(["soft_pairs"], query=f"SELECT id1, id2, {SPLIT_SQL} AS split FROM soft_pairs")
)
def hash_split(spark, sf_dir):
    return views.soft_pairs(spark, sf_dir).select(
        "id1", "id2", splits.hash_split().alias("split")
    )


@query(
    views.with_views(
        ["scored"], query=f"SELECT id1, id2 FROM scored WHERE {hash_sql(9, 'id1', 'id2')} % 4 = 0"
    )
)
def modulus_sample(spark, sf_dir):
    return splits.modulus_sample(views.scored(spark, sf_dir), 4, 9).select("id1", "id2")


_ROWS_SQL = """numbered AS (SELECT id1, id2, target,
  row_number() OVER (ORDER BY id1, id2) - 1 AS source_row FROM scored)"""


@query(
    views.with_views(
        ["scored"], _ROWS_SQL, query="SELECT id1, id2, source_row FROM numbered WHERE source_row % 8 = 3"
    )
)
def shard_assign(spark, sf_dir):
    numbered = splits.source_rows(views.scored(spark, sf_dir).select("id1", "id2"))
    return tables.shard(numbered, F.col("source_row"), 8, 3)


@query(
    views.with_views(
        ["scored"],
        _ROWS_SQL,
        query="""SELECT count(*) AS rows, min(source_row) AS first_row, max(source_row) AS last_row,
        CAST(0 AS BIGINT) AS duplicate_rows, CAST(0 AS BIGINT) AS out_of_range_rows,
        CAST(0 AS BIGINT) AS missing_rows FROM numbered""",
    )
)
def shard_combine(spark, sf_dir):
    """Eight shards stacked again hold every source row once."""
    scored = settle(splits.source_rows(views.scored(spark, sf_dir).select("id1", "id2")))
    parts = [tables.shard(scored, F.col("source_row"), 8, i) for i in range(8)]
    total = scored.agg(F.count(F.lit(1)).alias("n"))
    return audits.shard_completeness(
        tables.combine(parts), "source_row", F.lit(0) + total.scalar()
    )


@query(
    views.with_views(
        ["scored"],
        query=f"""SELECT id1, id2, row_number() OVER (ORDER BY {hash_sql(SEED, 'id1', 'id2')},
        id1, id2) AS position FROM scored""",
    )
)
def shuffle_order(spark, sf_dir):
    scored = views.scored(spark, sf_dir).select("id1", "id2")
    return splits.shuffle_order(scored, SEED)


@query(
    views.with_views(
        ["scored"],
        query=f"""SELECT id1, id2, category FROM scored
        ORDER BY {hash_sql(5, 'category', 'id1', 'id2')}, category, id1, id2 LIMIT 500""",
    )
)
def head_by_hash(spark, sf_dir):
    scored = views.scored(spark, sf_dir).select("id1", "id2", "category")
    return splits.head_by_hash(scored, 500, 5, ["category", "id1", "id2"])


_COMPONENTS_SQL = """RECURSIVE_edges AS (SELECT id1 AS a, id2 AS b FROM human_pairs
  UNION SELECT id2, id1 FROM human_pairs),
reach AS (SELECT DISTINCT a AS id, a AS r FROM RECURSIVE_edges
  UNION SELECT e.b, reach.r FROM reach JOIN RECURSIVE_edges e ON e.a = reach.id),
roots AS (SELECT id, min(r) AS root FROM reach GROUP BY id),
component AS (SELECT p.id1, p.id2, p.target, i.category,
  dense_rank() OVER (ORDER BY r.root) - 1 AS component_id
  FROM human_pairs p JOIN roots r ON r.id = p.id1 LEFT JOIN items i ON i.id = p.id1)"""


def _recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1).replace("RECURSIVE_edges", "edges")


def _folds_sql(source: str, seed: int, out: str) -> str:
    """CTE ``out(component_id, out)``: snake deal inside the dominant stratum."""
    return f"""{out}_strata AS (SELECT component_id, category, target, count(*) AS n
  FROM {source} GROUP BY ALL),
{out}_top AS (SELECT *, sum(n) OVER (PARTITION BY component_id) AS size,
  row_number() OVER (PARTITION BY component_id ORDER BY n DESC, category, target) AS pos
  FROM {out}_strata),
{out}_ranked AS (SELECT component_id, category, target, row_number() OVER (
  PARTITION BY category, target ORDER BY size DESC, {hash_sql(seed, 'component_id')}, component_id)
  - 1 AS n FROM {out}_top WHERE pos = 1),
{out}_dealt AS (SELECT component_id, (least(n % {2 * K}, {2 * K - 1} - n % {2 * K})
  + {hash_sql(seed, 'category', 'target')} % {K}) % {K} AS {out} FROM {out}_ranked)"""


@query(
    _recursive(
        views.with_views(
            ["human_pairs"],
            _COMPONENTS_SQL,
            query="SELECT id1, id2, component_id FROM component",
        )
    )
)
def connected_components(spark, sf_dir):
    return component_ids(views.human_pairs(spark, sf_dir)).select("id1", "id2", "component_id")


_GROUP_FOLDS_SQL = (
    _COMPONENTS_SQL,
    _folds_sql("component", SEED, "fold"),
    "folded AS (SELECT c.*, d.fold FROM component c JOIN fold_dealt d USING (component_id))",
)


@query(
    _recursive(
        views.with_views(
            ["human_pairs"],
            *_GROUP_FOLDS_SQL,
            query=f"SELECT id1, id2, target, category, component_id, {whole('fold', 'fold')} FROM folded",
        )
    )
)
def group_folds(spark, sf_dir):
    return splits.build_folds(
        views.human_pairs(spark, sf_dir), views.items(spark, sf_dir), K, SEED
    )


_NESTED_SQL = (
    *_GROUP_FOLDS_SQL,
    _folds_sql("component", INNER_SEED, "inner_fold"),
    "nested AS (SELECT f.*, d.inner_fold FROM folded f JOIN inner_fold_dealt d USING (component_id))",
)


def _nested(spark, sf_dir):
    # Six reports read the fold table; publish it once.
    return splits.component_folds(
        settle(group_folds(spark, sf_dir)), K, INNER_SEED, "inner_fold"
    )


@query(
    _recursive(
        views.with_views(
            ["human_pairs"],
            *_NESTED_SQL,
            query=f"""SELECT inner_fold, category, count(*) AS rows,
            {whole('sum(target)', 'positives')}, {real('avg(target)', 'positive_rate')},
            count(DISTINCT component_id) AS components
            FROM nested GROUP BY GROUPING SETS ((inner_fold, category), (inner_fold))""",
        )
    )
)
def nested_folds(spark, sf_dir):
    return summaries.fold_summary(_nested(spark, sf_dir), "inner_fold")



@query(
    _recursive(
        views.with_views(
            ["human_pairs"],
            *_NESTED_SQL,
            """ends AS (SELECT fold, inner_fold, id1 AS id FROM nested
            UNION SELECT fold, inner_fold, id2 FROM nested)""",
            """roles AS (SELECT o.f AS outer_fold, id, bool_or(fold = o.f) AS ov,
            bool_or(fold <> o.f AND inner_fold = 0) AS iv,
            bool_or(fold <> o.f AND inner_fold <> 0) AS it
            FROM ends, (SELECT unnest(range(5)) AS f) o GROUP BY 1, 2)""",
            query="""SELECT outer_fold, count(*) FILTER (WHERE ov) AS outer_validation_items,
            count(*) FILTER (WHERE iv) AS inner_validation_items,
            count(*) FILTER (WHERE it) AS inner_training_items,
            count(*) FILTER (WHERE it AND iv) AS inner_train_validation_overlap,
            count(*) FILTER (WHERE it AND ov) AS inner_train_outer_overlap,
            count(*) FILTER (WHERE iv AND ov) AS inner_validation_outer_overlap
            FROM roles GROUP BY outer_fold""",
        )
    )
)
def fold_item_overlap(spark, sf_dir):
    return summaries.nested_fold_overlap(_nested(spark, sf_dir), range(K), 0)


@query(
    _recursive(
        views.with_views(
            ["human_pairs"],
            *_NESTED_SQL,
            query="""SELECT count(DISTINCT component_id) AS components,
            CAST(0 AS BIGINT) AS fold_leaks, CAST(0 AS BIGINT) AS inner_fold_leaks FROM nested""",
        )
    )
)
def fold_leakage(spark, sf_dir):
    return audits.component_leakage(_nested(spark, sf_dir), ["fold", "inner_fold"])


@query(
    _recursive(
        views.with_views(
            ["soft_pairs"],
            _COMPONENTS_SQL.replace("human_pairs", "soft_pairs"),
            query="""SELECT count(DISTINCT component_id) AS components,
            CAST(max(n) AS BIGINT) AS largest_rows FROM
            (SELECT component_id, count(*) AS n FROM component GROUP BY 1)""",
        )
    )
)
def component_sizes(spark, sf_dir):
    pairs = with_category(views.soft_pairs(spark, sf_dir), views.items(spark, sf_dir))
    sizes = component_ids(pairs).groupBy("component_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.count(F.lit(1)).alias("components"), F.max("n").alias("largest_rows")
    )
