"""Registry and small helpers shared by the query modules."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 9


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function ``(spark, sf_dir) -> DataFrame`` under its name."""

    def add(function: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return comparable(function(spark, sf_dir))

        QUERIES[name or function.__name__] = Query(run, sql)
        return function

    return add


def comparable(df: DataFrame) -> DataFrame:
    """Widen integers, and round doubles: engines add up in different orders."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            column = column.cast("bigint")
        elif isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            column = F.round(column.cast("double"), DIGITS)
        columns.append(column.alias(field.name))
    return df.select(*columns)


# -- SQL text helpers ------------------------------------------------------------------


def real(expression: str, name: str) -> str:
    """Rounded double; adding zero clears a negative zero."""
    return f"round(CAST({expression} AS DOUBLE), {DIGITS}) + 0 AS {name}"


def whole(expression: str, name: str) -> str:
    return f"CAST({expression} AS BIGINT) AS {name}"


def hash_sql(seed: int | None, *columns: str) -> str:
    parts = ", ".join([*([] if seed is None else [str(seed)]), *columns])
    return f"CAST('0x' || substr(md5(concat_ws('|', {parts})), 1, 15) AS BIGINT)"


def average_rank_sql(keys: Sequence[str], value: str) -> str:
    group = ", ".join(keys)
    return (
        f"(rank() OVER (PARTITION BY {group} ORDER BY {value})"
        f" + (count(*) OVER (PARTITION BY {group}, {value}) - 1) / CAST(2 AS DOUBLE))"
    )


def precision_sql(
    source: str,
    keys: Sequence[str],
    score: str,
    cohorts: Mapping[str, str],
    target: str = "target",
    out: str = "ap",
) -> str:
    """CTEs ending in ``out(keys, cohort, rows, positives, average_precision)``."""
    group = ", ".join([*keys, "cohort"])
    picked = ", ".join(keys)
    rows = "\nUNION ALL\n".join(
        f"SELECT {picked}, '{name}' AS cohort, {score} AS s,"
        f" CASE WHEN {target} = 1 THEN 1 ELSE 0 END AS y FROM {source} WHERE {mask}"
        for name, mask in cohorts.items()
    )
    return f"""{out}_rows AS ({rows}),
{out}_cells AS (SELECT {group}, s, sum(y) AS p, count(*) AS n FROM {out}_rows GROUP BY {group}, s),
{out}_run AS (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM {out}_cells
  WINDOW w AS (PARTITION BY {group} ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
{out} AS (SELECT {group}, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(p) AS BIGINT) AS positives,
  CASE WHEN sum(p) = 0 THEN CAST(0 AS DOUBLE)
       ELSE sum(CAST(p * cp AS DOUBLE) / cn) / sum(p) END AS average_precision
  FROM {out}_run GROUP BY {group})"""


def spearman_sql(source: str, keys: Sequence[str], left: str, right: str, out: str) -> str:
    """CTEs ending in ``out(keys, rows, spearman)``."""
    group = ", ".join(keys)
    return f"""{out}_ranked AS (SELECT {group}, {average_rank_sql(keys, left)} AS rl,
  {average_rank_sql(keys, right)} AS rr FROM {source}),
{out} AS (SELECT {group}, count(*) AS rows, corr(rl, rr) AS spearman
  FROM {out}_ranked GROUP BY {group})"""


THRESHOLDS_SQL = """thresholds AS (SELECT category,
  quantile_cont(surface_similarity, 0.75) FILTER (WHERE target <= 0.2) AS hard_negative_min_similarity,
  quantile_cont(surface_similarity, 0.25) FILTER (WHERE target >= 0.8) AS hard_positive_max_similarity,
  count(*) FILTER (WHERE target <= 0.2) AS negative_candidates,
  count(*) FILTER (WHERE target >= 0.8) AS positive_candidates
  FROM scored GROUP BY category),
stressed AS (SELECT s.*, t.hard_negative_min_similarity, t.hard_positive_max_similarity
  FROM scored s JOIN thresholds t USING (category))"""

STRESS_SQL = {
    "hard_negative": "target = 1 OR surface_similarity >= hard_negative_min_similarity",
    "hard_positive": "target <> 1 OR surface_similarity <= hard_positive_max_similarity",
    "identity_conflict": "target = 1 OR identity_conflicts > 0",
}
