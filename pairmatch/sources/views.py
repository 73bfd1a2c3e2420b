"""Record-matching views over the shared test tables, for Spark and as SQL text.

Part ids are dealt to two label sources, even ids to the human one and odd ids to the
soft one, because the two sources must not share items; together they use every part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmatch.session import unbroadcast

_ATTRIBUTES = """
CASE WHEN p_partkey % 50 = 0 THEN NULL
     WHEN p_partkey % 50 = 1 THEN 'not-json'
     WHEN p_partkey % 50 = 2 THEN '[]'
     WHEN p_partkey % 50 = 3 THEN '{}'
     ELSE '{"other":"x' || CAST(p_partkey % 7 AS STRING) || '","size":"' || CAST(p_size AS STRING)
          || ' mm","model":"M' || CAST(p_partkey % 97 AS STRING) || '","brand":"' || p_brand || '"}' END
"""
_SCORED = """
l_orderkey AS id1,
l_orderkey * 10 + l_linenumber AS id2,
l_returnflag || l_linestatus AS category,
CAST(l_orderkey % 5 AS INT) AS fold,
CASE WHEN l_discount >= 0.05 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS target,
CAST((l_orderkey * 31 + l_linenumber * 17) % 10 AS DOUBLE) / CAST(9 AS DOUBLE) AS soft_target,
CAST((l_orderkey * 7919 + l_linenumber * 104729) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE)
  + CASE WHEN l_discount >= 0.05 THEN CAST(0.25 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS score_a,
CAST((l_orderkey * 6007 + l_linenumber * 15485863) % 500 AS DOUBLE) / CAST(500 AS DOUBLE)
  + CASE WHEN l_discount >= 0.05 THEN CAST(0.2 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS score_b,
CAST((l_orderkey * 3571 + l_linenumber * 32452843) % 20 AS DOUBLE) / CAST(20 AS DOUBLE)
  + CASE WHEN l_discount >= 0.05 THEN CAST(0.1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS score_c,
CAST((l_orderkey * 13 + l_linenumber * 101) % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS surface_similarity,
CAST((l_orderkey + l_linenumber) % 3 AS INT) AS identity_conflicts
"""
_SCORED_LINES = """
SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag,
       min(l_linestatus) AS l_linestatus, min(l_discount) AS l_discount
FROM lineitem GROUP BY l_orderkey, l_linenumber
"""
_TEACHER = """
CAST((p.id1 * 13 + p.id2 * 7) % 161 - 80 AS DOUBLE) / CAST(10 AS DOUBLE) AS teacher_logit_forward,
CAST((p.id1 * 11 + p.id2 * 5) % 161 - 80 AS DOUBLE) / CAST(10 AS DOUBLE) AS teacher_logit_backward
"""
HUMAN_STEPS = (2, 4, 6, 8)
SOFT_STEPS = (2, 4, 6, 8, 10, 12)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _columns(text: str) -> list[str]:
    """Select items of a block: split at commas that end a line."""
    return [item for item in text.strip().split(",\n")]


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id", "p_name AS name", f"{_ATTRIBUTES} AS attributes", "p_type AS category"
    )


def _neighbours(cards: DataFrame, parity: int, steps: Sequence[int], target: str) -> DataFrame:
    """Candidate pairs of nearby ids in one category: an equi-join on the computed id."""
    left = cards.where(F.col("id") % 2 == parity).select(
        F.col("id").alias("id1"),
        F.col("name").alias("left_name"),
        "category",
        F.explode(F.array(*[F.lit(s) for s in steps])).alias("step"),
    )
    right = cards.select(F.col("id").alias("id2"), F.col("name").alias("right_name"), "category")
    return (
        left.withColumn("id2", F.col("id1") + F.col("step"))
        .join(unbroadcast(right), ["id2", "category"])
        .selectExpr("id1", "id2", f"{target} AS target")
    )


def human_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(
        items(spark, sf_dir),
        0,
        HUMAN_STEPS,
        "CASE WHEN split_part(left_name, ' ', 2) = split_part(right_name, ' ', 2) THEN 1D ELSE 0D END",
    )


def soft_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(
        items(spark, sf_dir), 1, SOFT_STEPS, "CAST((id1 * 31 + id2 * 17) % 10 AS DOUBLE) / 9D"
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(
            F.min("l_returnflag").alias("l_returnflag"),
            F.min("l_linestatus").alias("l_linestatus"),
            F.min("l_discount").alias("l_discount"),
        )
    )
    return lines.selectExpr(*_columns(_SCORED))


def teacher(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = soft_pairs(spark, sf_dir).alias("p")
    cards = items(spark, sf_dir).select("id", "category")
    return pairs.join(unbroadcast(cards), F.col("id") == F.col("id1")).selectExpr(
        "p.id1", "p.id2", "p.target", "category", *_columns(_TEACHER)
    )


def _neighbours_sql(parity: int, steps: Sequence[int], target: str) -> str:
    values = ", ".join(f"({s})" for s in steps)
    return f"""
SELECT a.id AS id1, b.id AS id2, {target} AS target
FROM items a CROSS JOIN (VALUES {values}) AS o(k)
JOIN items b ON b.id = a.id + o.k AND b.category = a.category
WHERE a.id % 2 = {parity}"""


_SQL = {
    "items": "SELECT p_partkey AS id, p_name AS name,"
    + _ATTRIBUTES
    + " AS attributes, p_type AS category FROM part",
    "human_pairs": _neighbours_sql(
        0,
        HUMAN_STEPS,
        "CASE WHEN split_part(a.name, ' ', 2) = split_part(b.name, ' ', 2)"
        " THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END",
    ),
    "soft_pairs": _neighbours_sql(
        1, SOFT_STEPS, "CAST((a.id * 31 + b.id * 17) % 10 AS DOUBLE) / CAST(9 AS DOUBLE)"
    ),
    "scored": f"SELECT {_SCORED} FROM ({_SCORED_LINES}) AS l",
    "teacher": f"""
SELECT p.id1, p.id2, p.target, i.category, {_TEACHER}
FROM soft_pairs p JOIN items i ON i.id = p.id1""",
}
_NEEDS = {
    "human_pairs": ("items",),
    "soft_pairs": ("items",),
    "teacher": ("items", "soft_pairs"),
}


def with_views(names: Sequence[str], *ctes: str, query: str) -> str:
    """SQL text: the views, then further CTEs ``name AS (...)``, then the query."""
    ordered: list[str] = []
    for name in names:
        for view in (*_NEEDS.get(name, ()), name):
            if view not in ordered:
                ordered.append(view)
    parts = [f"{view} AS ({_SQL[view]})" for view in ordered]
    return "WITH " + ",\n".join([*parts, *ctes]) + "\n" + query
