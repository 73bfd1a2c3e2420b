"""Table contracts. Each audit is a one-row table of counts; ``enforce`` raises on it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmatch.functions.hashing import seeded_hash
from pairmatch.functions.numeric import finite
from pairmatch.session import settle, shuffle_width, task_count
from pairmatch.sources.tables import PAIR_KEYS


def enforce(audit: DataFrame, *violations: str) -> None:
    """Raise when a named counter of a one-row audit is not zero."""
    row = audit.select(*violations).first()
    broken = {name: row[name] for name in violations if row[name]}
    if broken:
        raise ValueError(f"table contract violated: {broken}")


def _how_many(condition: Column, name: str) -> Column:
    return F.count_if(condition).alias(name)


def item_table(items: DataFrame) -> DataFrame:
    """Rows, null ids and rows beyond the first of an id."""
    per_id = items.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("id").isNotNull()
    return per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("null_ids"),
        F.coalesce(F.sum(F.when(known, F.col("n") - 1)), F.lit(0)).alias("duplicate_ids"),
    )


def pair_table(pairs: DataFrame) -> DataFrame:
    missing = F.col("id1").isNull() | F.col("id2").isNull()
    return pairs.agg(F.count(F.lit(1)).alias("rows"), _how_many(missing, "null_id_rows"))


def unknown_items(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs whose items are not in the item table, and the distinct ids concerned.

    The pairs are counted first: the more there are, the more tasks their ends are dealt to.
    """
    # Built per task from the items alone: the pairs' ends pass it without a sort.
    known = items.select("id").distinct().hint("shuffle_hash")
    ends = pairs.select(F.explode(F.array(*PAIR_KEYS)).alias("id"))
    tasks = task_count(pairs.sparkSession, 2 * pairs.count())
    if tasks > shuffle_width(pairs.sparkSession):
        ends = ends.repartition(tasks, "id")
    absent = ends.join(known, "id", "left_anti").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return absent.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("missing_references"),
        F.count("id").alias("missing_items"),
    )


def joined_pairs(joined: DataFrame) -> DataFrame:
    """Required nulls and category mismatches after the item join."""
    required = (
        F.col("category").isNull() | F.col("left_name").isNull() | F.col("right_name").isNull()
    )
    return joined.agg(
        F.count(F.lit(1)).alias("rows"),
        _how_many(required, "required_null_rows"),
        _how_many(
            ~F.col("category").eqNullSafe(F.col("right_category")), "category_mismatch_rows"
        ),
    )


def rank_inputs(df: DataFrame, keys: Sequence[str], scores: Sequence[str]) -> DataFrame:
    """Rows that a ranking by ``keys`` refuses: null keys, null and NaN scores."""
    lost = [F.col(k).isNull() for k in keys]
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        _how_many(reduce(or_, lost), "null_key_rows"),
        *[_how_many(F.col(s).isNull(), f"null_{s}_rows") for s in scores],
        *[_how_many(F.isnan(F.col(s)), f"nan_{s}_rows") for s in scores],
    )


def uncovered_categories(df: DataFrame, parameters: DataFrame) -> DataFrame:
    """``category, rows`` of the rows whose category has no parameters."""
    known = parameters.select(F.col("category").alias("_known")).distinct()
    absent = df.join(known, F.col("category").eqNullSafe(F.col("_known")), "left_anti")
    return absent.groupBy("category").agg(F.count(F.lit(1)).alias("rows"))


def duplicate_pairs(df: DataFrame, keys: Sequence[str] = PAIR_KEYS) -> DataFrame:
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("distinct_keys"),
        _how_many(F.col("n") > 1, "duplicate_keys"),
    )


def contract(
    base: DataFrame,
    other: DataFrame,
    columns: Sequence[str] = ("target", "category", "fold"),
    keys: Sequence[str] = PAIR_KEYS,
    tolerance: float = 0.0,
) -> DataFrame:
    """Coverage and agreement of two tables with the same keys.

    Both sides are stacked and grouped, so one aggregation answers coverage in either
    direction, duplicate keys and mismatches. ``tolerance`` applies to numbers.
    """
    numeric = {f.name for f in base.schema if f.dataType.typeName() in ("double", "float")}

    def side(df: DataFrame, is_base: bool) -> DataFrame:
        return df.select(
            *keys,
            F.lit(is_base).alias("_base"),
            *[F.col(c).alias(f"_v{i}") for i, c in enumerate(columns)],
        )

    stacked = side(base, True).unionByName(side(other, False))
    both = stacked.groupBy(*keys).agg(
        F.count_if("_base").alias("_in_base"),
        F.count_if(~F.col("_base")).alias("_in_other"),
        *[
            F.max(F.when(flag, F.col(f"_v{i}"))).alias(f"_{name}{i}")
            for i in range(len(columns))
            for name, flag in (("l", F.col("_base")), ("r", ~F.col("_base")))
        ],
    )
    paired = (F.col("_in_base") > 0) & (F.col("_in_other") > 0)

    def differs(i: int, name: str) -> Column:
        left, right = F.col(f"_l{i}"), F.col(f"_r{i}")
        if name in numeric and tolerance:
            return ~left.eqNullSafe(right) & F.coalesce(
                F.abs(left - right) > tolerance, F.lit(True)
            )
        return ~left.eqNullSafe(right)

    mismatch = F.lit(False)
    for i, name in enumerate(columns):
        mismatch = mismatch | differs(i, name)
    return both.agg(
        F.coalesce(F.sum("_in_base"), F.lit(0)).alias("base_rows"),
        F.coalesce(F.sum("_in_other"), F.lit(0)).alias("other_rows"),
        _how_many(F.col("_in_other") == 0, "uncovered_keys"),
        _how_many(F.col("_in_base") == 0, "unexpected_keys"),
        _how_many((F.col("_in_base") > 1) | (F.col("_in_other") > 1), "duplicate_keys"),
        _how_many(paired & mismatch, "mismatched_keys"),
    )


def component_leakage(df: DataFrame, folds: Sequence[str] = ("fold",)) -> DataFrame:
    """Components whose rows lie in more than one fold, per fold column."""
    spans = df.groupBy("component_id").agg(
        *[(F.min(f) != F.max(f)).alias(f"_{f}") for f in folds]
    )
    return spans.agg(
        F.count(F.lit(1)).alias("components"),
        *[_how_many(F.col(f"_{f}"), f"{f}_leaks") for f in folds],
    )


def non_finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[_how_many(~finite(F.col(c)), f"{c}_bad") for c in columns],
    )


def value_range(
    df: DataFrame, columns: Sequence[str], low: float = 0.0, high: float = 1.0
) -> DataFrame:
    """Rows outside [low, high]; null and NaN count as outside."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[
            _how_many(~(finite(F.col(c)) & F.col(c).between(low, high)), f"{c}_out_of_range")
            for c in columns
        ],
    )


def label_domain(df: DataFrame, column: str = "target", binary: bool = True) -> DataFrame:
    value = F.col(column)
    good = value.isin(0.0, 1.0) if binary else value.between(0.0, 1.0)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        _how_many(~F.coalesce(good & finite(value), F.lit(False)), "invalid_labels"),
    )


def metric_input(df: DataFrame, score: str, target: str, category: str) -> DataFrame:
    """What a ranking metric refuses: non-finite scores, odd labels, null categories."""
    label = F.col(target).cast("double")
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        _how_many(~finite(F.col(score)), "bad_scores"),
        _how_many(~(finite(label) & label.isin(0.0, 1.0)), "bad_labels"),
        _how_many(F.col(category).isNull(), "null_categories"),
    )


def shard_completeness(df: DataFrame, row: str, expected_rows: int | Column) -> DataFrame:
    """Source rows 0..n-1 present exactly once."""
    expected = expected_rows if isinstance(expected_rows, Column) else F.lit(expected_rows)
    per_row = df.groupBy(row).agg(F.count(F.lit(1)).alias("n"))
    out_of_range = F.col(row).isNull() | (F.col(row) < 0) | (F.col(row) >= expected)
    counted = per_row.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.min(row).alias("first_row"),
        F.max(row).alias("last_row"),
        _how_many(F.col("n") > 1, "duplicate_rows"),
        _how_many(out_of_range, "out_of_range_rows"),
        (F.max(expected) - _how_many(~out_of_range, "_")).alias("missing_rows"),
    )
    return counted


def unchanged(df: DataFrame, routed: Column, before: str, after: str) -> DataFrame:
    """Rows outside the route whose value moved."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        _how_many(routed, "routed_rows"),
        _how_many(~routed & ~F.col(before).eqNullSafe(F.col(after)), "changed_outside_route"),
    )


def output_table(predictions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Predictions against the requested pairs: coverage both ways and finite scores."""
    if predictions.columns != [*PAIR_KEYS, "predict"]:
        raise ValueError(f"unexpected output schema: {predictions.columns}")
    stacked = predictions.select(
        *PAIR_KEYS, F.lit(1).alias("_out"), finite(F.col("predict")).alias("_ok")
    ).unionByName(pairs.select(*PAIR_KEYS, F.lit(0).alias("_out"), F.lit(True).alias("_ok")))
    per_key = stacked.groupBy(*PAIR_KEYS).agg(
        F.sum("_out").alias("_o"),
        F.sum(1 - F.col("_out")).alias("_p"),
        F.count_if(~F.col("_ok")).alias("_bad"),
    )
    return per_key.agg(
        F.coalesce(F.sum("_o"), F.lit(0)).alias("output_rows"),
        F.coalesce(F.sum("_p"), F.lit(0)).alias("requested_rows"),
        _how_many(F.col("_o") < F.col("_p"), "uncovered_pairs"),
        _how_many(F.col("_o") > F.col("_p"), "unexpected_pairs"),
        F.coalesce(F.sum("_bad"), F.lit(0)).alias("non_finite_rows"),
    )


def category_coverage(
    df: DataFrame, folds: str | None = None, expected_categories: int | None = None
) -> DataFrame:
    """Observed categories, and the (fold, category) cells that hold no row."""
    keys = [folds, "category"] if folds else ["category"]
    cells = df.select(*keys).distinct()
    seen = cells.agg(
        F.count_distinct("category").alias("categories"),
        F.count(F.lit(1)).alias("cells"),
        *([F.count_distinct(folds).alias("folds")] if folds else []),
    )
    wanted = F.lit(expected_categories) if expected_categories else F.col("categories")
    full = wanted * (F.col("folds") if folds else F.lit(1))
    return seen.select(
        "categories",
        "cells",
        (F.col("categories") - wanted).cast("bigint").alias("category_surplus"),
        (full - F.col("cells")).cast("bigint").alias("missing_cells"),
    )


def fingerprint(df: DataFrame, columns: Sequence[str], method: str = "xxhash64") -> DataFrame:
    """Row count and order-insensitive content fingerprint of the named columns."""
    value = seeded_hash(None, *columns, method=method)
    return df.select(value.alias("_h")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.bit_xor("_h"), F.lit(0)).alias("xor_hash"),
        F.coalesce(F.sum(F.col("_h").cast("decimal(38,0)")), F.lit(0))
        .cast("string")
        .alias("sum_hash"),
    )


def lineage(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Named fingerprints against a contract table: one row per table, with a verdict."""
    renamed = expected.select(
        "table_name", *[F.col(c).alias(f"expected_{c}") for c in ("rows", "xor_hash", "sum_hash")]
    )
    same = F.lit(True)
    for column in ("rows", "xor_hash", "sum_hash"):
        same = same & F.col(column).eqNullSafe(F.col(f"expected_{column}"))
    return found.join(renamed, "table_name", "full_outer").select(
        "table_name", "rows", "xor_hash", "sum_hash", same.alias("verified")
    )


def range_prints(df: DataFrame, key: str, columns: Sequence[str], width: int, method: str = "xxhash64") -> DataFrame:
    """``bucket, rows, xor_hash, sum_hash`` for every ``width`` values of a whole-number key.

    What a contract keeps of a table: a few numbers per range, from which a difference is
    located without a second copy. Null keys are a bucket of their own (null).
    """
    value = seeded_hash(None, key, *columns, method=method)
    bucket = F.floor(F.col(key) / F.lit(width)).cast("bigint")
    return df.select(bucket.alias("bucket"), value.alias("_h")).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("rows"),
        F.bit_xor("_h").alias("xor_hash"),
        F.sum(F.col("_h").cast("decimal(38,0)")).cast("string").alias("sum_hash"),
    )


def compare_prints(found: DataFrame, contract: DataFrame) -> DataFrame:
    """``bucket, rows, contract_rows, verified`` of every range on either side."""
    parts = ("rows", "xor_hash", "sum_hash")
    left = found.select("bucket", *[F.col(c).alias(f"_f_{c}") for c in parts]).alias("f")
    right = contract.select("bucket", *[F.col(c).alias(f"_c_{c}") for c in parts]).alias("c")
    same = F.lit(True)
    for c in parts:
        same = same & F.col(f"_f_{c}").eqNullSafe(F.col(f"_c_{c}"))
    return left.join(right, F.col("f.bucket").eqNullSafe(F.col("c.bucket")), "full_outer").select(
        F.coalesce("f.bucket", "c.bucket").alias("bucket"),
        F.coalesce("_f_rows", F.lit(0)).alias("rows"),
        F.coalesce("_c_rows", F.lit(0)).alias("contract_rows"),
        same.alias("verified"),
    )


def differing_rows(
    found: DataFrame, expected: DataFrame, key: str, columns: Sequence[str], width: int, method: str = "xxhash64"
) -> DataFrame:
    """``key, difference``: keys that are ``missing``, ``unexpected`` or ``changed``.

    The first pass compares the ranges' prints; only rows of ranges that differ are read
    again and joined. The rows of a repeated key are compared by their prints as well.
    """
    verdicts = compare_prints(
        range_prints(found, key, columns, width, method), range_prints(expected, key, columns, width, method)
    )
    wrong = settle(verdicts.where(~F.col("verified")).select(F.col("bucket").alias("_bucket")))

    def rows(df: DataFrame, flag: str) -> DataFrame:
        bucket = F.floor(F.col(key) / F.lit(width)).cast("bigint")
        value = seeded_hash(None, key, *columns, method=method)
        near = df.join(wrong, bucket.eqNullSafe(F.col("_bucket")), "left_semi")
        print_ = F.struct(F.count(F.lit(1)), F.bit_xor(value), F.sum(value.cast("decimal(38,0)")))
        return near.groupBy(F.col(key).alias("_key")).agg(print_.alias(flag))

    both = rows(found, "_found").alias("f").join(
        rows(expected, "_expected").alias("e"), F.col("f._key").eqNullSafe(F.col("e._key")), "full_outer"
    )
    told = (
        F.when(F.col("_found").isNull(), "missing")
        .when(F.col("_expected").isNull(), "unexpected")
        .when(F.col("_found") != F.col("_expected"), "changed")
    )
    return both.select(F.coalesce("f._key", "e._key").alias(key), told.alias("difference")).where("difference is not null")
