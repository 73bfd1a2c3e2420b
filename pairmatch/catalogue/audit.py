"""Table contracts over the views, and over raw lineitem, whose keys repeat."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairmatch.catalogue.registry import hash_sql, query, whole
from pairmatch.operators import audits, joins, summaries
from pairmatch.sources import views


@query(
    views.with_views(
        ["items"],
        query="""SELECT count(*) AS rows, count(*) FILTER (WHERE id IS NULL) AS null_ids,
        count(id) - count(DISTINCT id) AS duplicate_ids FROM items""",
    )
)
def item_table_audit(spark, sf_dir):
    return audits.item_table(views.items(spark, sf_dir))


@query(
    views.with_views(
        ["human_pairs"],
        query="""SELECT count(*) AS rows,
        count(*) FILTER (WHERE id1 IS NULL OR id2 IS NULL) AS null_id_rows FROM human_pairs""",
    )
)
def pair_table_audit(spark, sf_dir):
    return audits.pair_table(views.human_pairs(spark, sf_dir))


@query(
    views.with_views(
        ["items", "scored"],
        """ends AS (SELECT id1 AS id FROM scored UNION ALL SELECT id2 FROM scored)""",
        query="""SELECT count(*) AS missing_references, count(DISTINCT id) AS missing_items
        FROM ends WHERE id NOT IN (SELECT id FROM items)""",
    )
)
def unknown_items_audit(spark, sf_dir):
    return audits.unknown_items(views.scored(spark, sf_dir), views.items(spark, sf_dir))


@query(
    """SELECT count(*) AS rows, count(*) FILTER (WHERE p1.p_type IS NULL OR p1.p_name IS NULL
      OR p2.p_name IS NULL) AS required_null_rows,
    count(*) FILTER (WHERE p1.p_type IS DISTINCT FROM p2.p_type) AS category_mismatch_rows
    FROM lineitem l JOIN part p1 ON p1.p_partkey = l.l_partkey
    JOIN part p2 ON p2.p_partkey = l.l_suppkey"""
)
def joined_pairs_audit(spark, sf_dir):
    """Pairs of arbitrary parts, most of which cross categories."""
    pairs = views.table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("id1"), F.col("l_suppkey").alias("id2")
    )
    return audits.joined_pairs(joins.pair_join(pairs, views.items(spark, sf_dir), ["name"]))


@query(
    """SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_keys,
    count(*) FILTER (WHERE n > 1) AS duplicate_keys FROM
    (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)"""
)
def duplicate_pairs(spark, sf_dir):
    lines = views.table(spark, sf_dir, "lineitem")
    return audits.duplicate_pairs(lines, ["l_orderkey", "l_linenumber"])


_OTHER_SQL = """other AS (SELECT id1, id2, category, (fold + CAST(id1 % 7 = 0 AS INT)) % 5 AS fold,
  target + CASE WHEN id1 % 11 = 0 THEN 0.5 ELSE 0.00000001 END AS target
  FROM scored WHERE id2 % 13 <> 0)"""


@query(
    views.with_views(
        ["scored"],
        _OTHER_SQL,
        query="""SELECT (SELECT count(*) FROM scored) AS base_rows,
        (SELECT count(*) FROM other) AS other_rows,
        count(*) FILTER (WHERE o.id1 IS NULL) AS uncovered_keys,
        CAST(0 AS BIGINT) AS unexpected_keys, CAST(0 AS BIGINT) AS duplicate_keys,
        count(*) FILTER (WHERE o.id1 IS NOT NULL AND (abs(s.target - o.target) > 1e-7
          OR s.category <> o.category OR s.fold <> o.fold)) AS mismatched_keys
        FROM scored s LEFT JOIN other o USING (id1, id2)""",
    )
)
def contract_mismatch(spark, sf_dir):
    """A second table with missing pairs, moved folds and shifted targets."""
    scored = views.scored(spark, sf_dir)
    other = scored.where("id2 % 13 <> 0").select(
        "id1",
        "id2",
        "category",
        F.expr("(fold + CAST(id1 % 7 = 0 AS INT)) % 5").alias("fold"),
        F.expr("target + CASE WHEN id1 % 11 = 0 THEN 0.5D ELSE 0.00000001D END").alias("target"),
    )
    return audits.contract(scored, other, tolerance=1e-7)


@query(
    views.with_views(
        ["scored"],
        """odd AS (SELECT CASE WHEN id1 % 9 = 0 THEN NULL WHEN id1 % 9 = 1 THEN 'NaN'::DOUBLE
        WHEN id1 % 9 = 2 THEN 'Infinity'::DOUBLE ELSE score_a END AS score_a, score_b FROM scored)""",
        query="""SELECT count(*) AS rows,
        count(*) FILTER (WHERE score_a IS NULL OR NOT isfinite(score_a)) AS score_a_bad,
        count(*) FILTER (WHERE score_b IS NULL OR NOT isfinite(score_b)) AS score_b_bad FROM odd""",
    )
)
def non_finite_audit(spark, sf_dir):
    odd = views.scored(spark, sf_dir).withColumn(
        "score_a",
        F.expr(
            "CASE WHEN id1 % 9 = 0 THEN NULL WHEN id1 % 9 = 1 THEN double('NaN')"
            " WHEN id1 % 9 = 2 THEN double('Infinity') ELSE score_a END"
        ),
    )
    return audits.non_finite(odd, ["score_a", "score_b"])


@query(
    views.with_views(
        ["scored"],
        query="""SELECT count(*) AS rows,
        count(*) FILTER (WHERE NOT (score_a BETWEEN 0 AND 1)) AS score_a_out_of_range,
        count(*) FILTER (WHERE NOT (surface_similarity BETWEEN 0 AND 1))
          AS surface_similarity_out_of_range FROM scored""",
    )
)
def range_audit(spark, sf_dir):
    return audits.value_range(views.scored(spark, sf_dir), ["score_a", "surface_similarity"])


@query(
    views.with_views(
        ["scored"],
        query="""SELECT 'binary' AS label, count(*) AS rows,
        count(*) FILTER (WHERE soft_target NOT IN (0, 1)) AS invalid_labels FROM scored
        UNION ALL SELECT 'probability', count(*),
        count(*) FILTER (WHERE NOT (soft_target BETWEEN 0 AND 1)) FROM scored""",
    )
)
def label_domain_audit(spark, sf_dir):
    scored = views.scored(spark, sf_dir)
    return summaries.stack(
        [
            audits.label_domain(scored, "soft_target", binary).select(
                F.lit(name).alias("label"), "rows", "invalid_labels"
            )
            for name, binary in (("binary", True), ("probability", False))
        ]
    )


@query(
    views.with_views(
        ["scored"],
        """odd AS (SELECT CASE WHEN id1 % 17 = 0 THEN 'NaN'::DOUBLE ELSE score_a END AS score,
        soft_target AS target, CASE WHEN id1 % 19 = 0 THEN NULL ELSE category END AS category
        FROM scored)""",
        query="""SELECT count(*) AS rows, count(*) FILTER (WHERE NOT isfinite(score)) AS bad_scores,
        count(*) FILTER (WHERE target NOT IN (0, 1)) AS bad_labels,
        count(*) FILTER (WHERE category IS NULL) AS null_categories FROM odd""",
    )
)
def metric_input_audit(spark, sf_dir):
    odd = views.scored(spark, sf_dir).selectExpr(
        "CASE WHEN id1 % 17 = 0 THEN double('NaN') ELSE score_a END AS score",
        "soft_target AS target",
        "CASE WHEN id1 % 19 = 0 THEN NULL ELSE category END AS category",
    )
    return audits.metric_input(odd, "score", "target", "category")


@query(
    """SELECT CAST(sum(n) AS BIGINT) AS rows, min(k) AS first_row, max(k) AS last_row,
    count(*) FILTER (WHERE n > 1) AS duplicate_rows,
    count(*) FILTER (WHERE k < 0 OR k >= (SELECT count(*) FROM orders)) AS out_of_range_rows,
    (SELECT count(*) FROM orders) - count(*) FILTER (WHERE k >= 0
      AND k < (SELECT count(*) FROM orders)) AS missing_rows
    FROM (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1)"""
)
def shard_completeness_audit(spark, sf_dir):
    """Line items as shards of the orders: keys repeat and some orders have no line."""
    orders = views.table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("n"))
    lines = views.table(spark, sf_dir, "lineitem")
    expected = lines.withColumn("_expected", orders.scalar())
    return audits.shard_completeness(expected, "l_orderkey", F.lit(0) + orders.scalar())


@query(
    views.with_views(
        ["scored"],
        query="""SELECT count(*) AS rows, count(*) FILTER (WHERE category IN ('AF', 'RO')) AS routed_rows,
        count(*) FILTER (WHERE category NOT IN ('AF', 'RO') AND id1 % 100 = 0)
          AS changed_outside_route FROM scored""",
    )
)
def unchanged_audit(spark, sf_dir):
    moved = views.scored(spark, sf_dir).withColumn(
        "after",
        F.expr("CASE WHEN category IN ('AF', 'RO') OR id1 % 100 = 0 THEN score_a + 1 ELSE score_a END"),
    )
    return audits.unchanged(moved, F.col("category").isin("AF", "RO"), "score_a", "after")


@query(
    views.with_views(
        ["soft_pairs"],
        """out AS (SELECT id1, id2, CASE WHEN id1 % 10 = 1 THEN 'NaN'::DOUBLE ELSE target END AS predict
        FROM soft_pairs WHERE id2 % 4 <> 1 UNION ALL SELECT -id1, id2, target FROM soft_pairs
        WHERE id2 % 8 = 3)""",
        query="""SELECT (SELECT count(*) FROM out) AS output_rows,
        (SELECT count(*) FROM soft_pairs) AS requested_rows,
        (SELECT count(*) FROM soft_pairs p ANTI JOIN out o USING (id1, id2)) AS uncovered_pairs,
        (SELECT count(*) FROM out o ANTI JOIN soft_pairs p USING (id1, id2)) AS unexpected_pairs,
        (SELECT count(*) FROM out WHERE isnan(predict)) AS non_finite_rows""",
    )
)
def output_audit(spark, sf_dir):
    pairs = views.soft_pairs(spark, sf_dir)
    shifted = pairs.where("id2 % 4 <> 1").selectExpr(
        "id1", "id2", "CASE WHEN id1 % 10 = 1 THEN double('NaN') ELSE target END AS predict"
    )
    extra = pairs.where("id2 % 8 = 3").selectExpr("-id1 AS id1", "id2", "target AS predict")
    return audits.output_table(shifted.unionByName(extra), pairs)


@query(
    views.with_views(
        ["scored"],
        query="""SELECT count(DISTINCT category) AS categories,
        count(DISTINCT (fold, category)) AS cells,
        count(DISTINCT category) - 7 AS category_surplus,
        7 * count(DISTINCT fold) - count(DISTINCT (fold, category)) AS missing_cells FROM scored""",
    )
)
def coverage_audit(spark, sf_dir):
    return audits.category_coverage(views.scored(spark, sf_dir), "fold", 7)


_PRINTS = {
    "part": ("p_partkey", "p_name", "p_type"),
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus"),
    "labels": ("doc_id", "quality", "toxic"),
}


def _print_sql(name: str, columns: tuple[str, ...]) -> str:
    value = hash_sql(None, *columns)
    return f"""SELECT '{name}' AS table_name, count(*) AS rows, bit_xor({value}) AS xor_hash,
    CAST(sum(CAST({value} AS HUGEINT)) AS VARCHAR) AS sum_hash, true AS verified FROM {name}"""


@query(" UNION ALL ".join(_print_sql(n, c) for n, c in _PRINTS.items()))
def lineage_fingerprint(spark, sf_dir):
    """Fingerprints of three tables, verified against a contract written from them."""
    prints = summaries.stack(
        [
            audits.fingerprint(views.table(spark, sf_dir, name), columns, "md5").select(
                F.lit(name).alias("table_name"), "*"
            )
            for name, columns in _PRINTS.items()
        ]
    )
    return audits.lineage(prints, prints)


@query(
    views.with_views(
        ["scored"],
        "weighted AS (SELECT id1, count(DISTINCT fold) AS f FROM scored GROUP BY id1)",
        query=f"""SELECT count(*) AS components, {whole('count(*) FILTER (WHERE f > 1)', 'fold_leaks')},
        (SELECT count(*) FROM (SELECT id1 FROM scored GROUP BY id1
          HAVING count(DISTINCT identity_conflicts) > 1)) AS identity_conflicts_leaks FROM weighted""",
    )
)
def component_leakage(spark, sf_dir):
    """Orders as components: folds hold them together, another column does not."""
    scored = views.scored(spark, sf_dir).withColumn("component_id", F.col("id1"))
    return audits.component_leakage(scored, ["fold", "identity_conflicts"])
