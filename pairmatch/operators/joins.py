"""Pair-to-item and table-to-table joins with their load-time contracts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmatch.functions.numeric import finite
from pairmatch.functions.text import with_byte_similarity
from pairmatch.session import unbroadcast
from pairmatch.sources.tables import PAIR_KEYS

ITEM_FIELDS = ("name", "attributes")


def pair_join(
    pairs: DataFrame, items: DataFrame, fields: Sequence[str] = ITEM_FIELDS, how: str = "inner"
) -> DataFrame:
    """Both items of each pair: ``category, right_category, left_<f>, right_<f>``.

    Two equi-joins on the item id. A hub item on the pair side is split by the adaptive
    skew join, because the item side has one row per id.
    """
    left = items.select(
        F.col("id").alias("id1"), "category", *[F.col(f).alias(f"left_{f}") for f in fields]
    )
    right = items.select(
        F.col("id").alias("id2"),
        F.col("category").alias("right_category"),
        *[F.col(f).alias(f"right_{f}") for f in fields],
    )
    joined = pairs.drop("category").join(unbroadcast(left), "id1", how).join(unbroadcast(right), "id2", how)
    rest = [c for c in pairs.columns if c not in (*PAIR_KEYS, "category")]
    return joined.select(
        *PAIR_KEYS,
        *rest,
        "category",
        "right_category",
        *[f"{side}_{f}" for f in fields for side in ("left", "right")],
    )


def with_surface_similarity(joined: DataFrame, out: str = "surface_similarity") -> DataFrame:
    """Byte-set similarity of the two names, stored as a float."""
    compared = with_byte_similarity(joined, out, F.col("left_name"), F.col("right_name"))
    return compared.withColumn(out, F.col(out).cast("float"))


def pair_cards(pairs: DataFrame, cards: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Attach the item cards of both sides as structs ``left_card`` and ``right_card``."""
    card = F.struct(*fields)
    left = cards.select(F.col("id").alias("id1"), "category", card.alias("left_card"))
    right = cards.select(F.col("id").alias("id2"), card.alias("right_card"))
    return pairs.drop("category").join(unbroadcast(left), "id1").join(unbroadcast(right), "id2")


def unique_rows(df: DataFrame, keys: Sequence[str], fields: Sequence[str], what: str) -> DataFrame:
    """``keys, fields`` with one row per key; a key with several rows fails the job.

    The grouping is the shuffle that a join on the keys needs anyway, and the check is part
    of the fields, so a lookup can't multiply rows and costs no pass of its own.
    """
    key = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    several = F.raise_error(F.concat(F.lit(f"{what}: several rows of key "), key))
    once = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.any_value(f).alias(f) for f in fields]
    )
    return once.select(*keys, *[F.when(F.col("_rows") > 1, several).otherwise(F.col(f)).alias(f) for f in fields])


def with_category(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Category of the first item of each pair, null when the item is unknown.

    An item with several rows fails the job where a pair asks for it.
    """
    lookup = unique_rows(items, ["id"], ["category"], "items").withColumnRenamed("id", "id1")
    return pairs.join(unbroadcast(lookup), "id1", "left").select(*pairs.columns, "category")


def join_scores(
    base: DataFrame, others: Mapping[str, DataFrame], score: str = "predict"
) -> DataFrame:
    """Left-join one score column per model onto the base pairs by pair key.

    Nothing is checked; ``validated_scores`` is the join with its contract.
    """
    joined = base
    for name, other in others.items():
        joined = joined.join(
            other.select(*PAIR_KEYS, F.col(score).alias(name)), list(PAIR_KEYS), "left"
        )
    return joined


def validated_scores(
    base: DataFrame,
    others: Mapping[str, DataFrame],
    score: str = "predict",
    same: Sequence[str] = ("target",),
    tolerance: float = 1e-7,
) -> DataFrame:
    """``base`` with one score column per model, or a failed job that names what is wrong.

    Every table has to hold exactly the pairs of ``base``, each once, with finite scores and
    with the same values in the columns ``same`` (numbers within ``tolerance``). All tables
    are stacked and grouped by the pair once, whatever their number; a group holds one row
    per table, and the checks are part of its columns.
    """
    numbers = {f.name for f in base.schema if f.dataType.typeName() in ("double", "float", "decimal")}
    rest = [c for c in base.columns if c not in PAIR_KEYS]
    if clash := set(others) & set(base.columns):
        raise ValueError(f"the base already has {sorted(clash)}")

    kept = base.select(F.struct(*rest)).schema[0].dataType

    def side(df: DataFrame, name: str, own: bool):
        return df.select(
            *PAIR_KEYS,
            F.lit(name).alias("_table"),
            (F.struct(*rest) if own else F.lit(None).cast(kept)).alias("_base"),
            (F.lit(None) if own else F.col(score)).cast("double").alias("_score"),
            F.struct(F.lit(0).alias("_"), *same).alias("_same"),
        )

    stacked = side(base, "", True)
    for name, df in others.items():
        stacked = stacked.unionByName(side(df, name, False))

    def of(name: str, value: str):
        return F.any_value(F.when(F.col("_table") == name, F.col(value)), True)

    # A pair is once in each table, so nothing combines before the shuffle: rows are dealt first and sorted once.
    dealt = stacked.repartition(*PAIR_KEYS)
    grouped = dealt.groupBy(*PAIR_KEYS).agg(
        F.count_if(F.col("_table") == "").alias("_rows"),
        of("", "_base").alias("_base"),
        of("", "_same").alias("_same"),
        *[F.count_if(F.col("_table") == n).alias(f"_n_{i}") for i, n in enumerate(others)],
        *[of(n, "_score").alias(f"_s_{i}") for i, n in enumerate(others)],
        *[of(n, "_same").alias(f"_v_{i}") for i, n in enumerate(others)],
    )
    pair = F.concat(F.lit("pair "), F.coalesce(F.col("id1").cast("string"), F.lit("null")), F.lit(", "),
                    F.coalesce(F.col("id2").cast("string"), F.lit("null")))

    def failing(text: str):
        return F.raise_error(F.concat(pair, F.lit(f" {text}")))

    def checked(i: int, name: str):
        value, count = F.col(f"_s_{i}"), F.col(f"_n_{i}")
        differ = F.lit(False)
        for c in same:
            left, right = F.col("_same")[c], F.col(f"_v_{i}")[c]
            equal = left.eqNullSafe(right)
            if c in numbers:
                equal = equal | F.coalesce(F.abs(left - right) <= tolerance, F.lit(False))
            differ = differ | ~equal
        return (
            F.when(F.col("_rows") == 0, failing(f"of {name} is not asked for"))
            .when(F.col("_rows") > 1, failing("is repeated in the base"))
            .when(count == 0, failing(f"is missing in {name}"))
            .when(count > 1, failing(f"is repeated in {name}"))
            .when(~finite(value), failing(f"has no finite score in {name}"))
            .when(differ, failing(f"has other {', '.join(same)} in {name}"))
            .otherwise(value)
            .alias(name)
        )

    return grouped.select(
        *PAIR_KEYS, *[F.col("_base")[c].alias(c) for c in rest], *[checked(i, n) for i, n in enumerate(others)]
    ).select(*base.columns, *others)


def with_category_parameters(
    df: DataFrame, parameters: DataFrame, fields: Sequence[str], how: str = "required"
) -> DataFrame:
    """Per-category parameters (weights, quotas, thresholds) on every row.

    A row whose category has no parameters fails the job; pass ``how="left"`` where nulls
    are wanted. Left without a hint: the planner broadcasts the table while its measured
    size allows it and shuffles otherwise.
    """
    if how != "required":
        return df.join(parameters.select("category", *fields), "category", how).select(
            *df.columns, *fields
        )
    known = parameters.select("category", *fields, F.lit(True).alias("_known"))
    category = F.coalesce(F.col("category").cast("string"), F.lit("null"))
    refused = F.raise_error(F.concat(F.lit("no parameters for category "), category))
    return df.join(known, "category", "left").select(
        *df.columns,
        *[F.when(F.col("_known").isNull(), refused).otherwise(F.col(f)).alias(f) for f in fields],
    )
