"""Scoring pair tables with any batch scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairmatch import fixed_values as fixed
from pairmatch.functions.attributes import item_text
from pairmatch.functions.evidence import (
    CARD_FIELDS,
    Groups,
    item_cards,
    pair_text,
    with_evidence,
)
from pairmatch.functions.numeric import logistic
from pairmatch.functions.text import (
    byte_set,
    byte_similarity,
    with_byte_similarity,
    with_normalized,
)
from pairmatch.operators.joins import pair_cards
from pairmatch.session import settle

Scorer = Callable[[DataFrame], DataFrame]

# Logit of the built-in evidence scorer.
EVIDENCE_WEIGHTS = {
    "intercept": -1.0,
    "surface_similarity": 2.0,
    "identity_matches": 1.0,
    "identity_conflicts": -1.0,
    "missing_identity_fields": -0.25,
}


def evidence_table(
    pairs: DataFrame,
    items: DataFrame,
    mode: str = "item",
    groups: Groups = fixed.IDENTITY_GROUPS,
    budget: int = fixed.ATTRIBUTE_BUDGET,
) -> DataFrame:
    """Model texts and label-free diagnostics of every pair.

    Mode ``item`` gives one text per side, mode ``pair`` one canonical text (and an empty
    right text).
    """
    if mode not in ("item", "pair"):
        raise ValueError(f"unknown serialization mode: {mode}")
    cards = item_cards(items, groups, budget, parsed_too=mode == "item")
    named = with_normalized(cards, {"shown_category": F.col("category")})
    # A pair carries only what its mode shows.
    if mode == "item":
        text = item_text(F.col("shown_category"), F.col("normal_name"), F.col("entries"), budget)
        named = named.withColumn("text", text)
        fields = ["identity", "title_ids", "name", "name_bytes", "text"]
    else:
        fields = [*CARD_FIELDS, "name", "name_bytes", "shown_category"]
    # Both sides of every pair read the cards: parse the items once.
    cards = settle(
        named.withColumn("name_bytes", byte_set(F.col("name"))).select("id", "category", *fields)
    )
    evident = with_evidence(pair_cards(pairs, cards, fields), groups=groups)
    left, right = F.col("left_card"), F.col("right_card")
    if mode == "item":
        texts = [left["text"].alias("left_text"), right["text"].alias("right_text")]
    else:
        canonical = pair_text(left["shown_category"], left, right)
        texts = [canonical.alias("left_text"), F.lit("").alias("right_text")]
    rest = [c for c in pairs.columns if c not in ("id1", "id2", "category")]
    return evident.select(
        "id1",
        "id2",
        *rest,
        "category",
        *texts,
        byte_similarity(left["name"], right["name"], left["name_bytes"], right["name_bytes"])
        .cast("float")
        .alias("surface_similarity"),
        F.size("matches").alias("identity_matches"),
        F.size("conflicts").alias("identity_conflicts"),
        F.size("missing").alias("missing_identity_fields"),
    )


def evidence_scorer(weights: Mapping[str, float] = EVIDENCE_WEIGHTS) -> Scorer:
    """Linear logit of the diagnostics, as a plain expression."""

    def score(df: DataFrame) -> DataFrame:
        logit = F.lit(weights["intercept"])
        for name, weight in weights.items():
            if name != "intercept":
                logit = logit + F.lit(weight) * F.col(name).cast("double")
        return df.withColumn("logit", logit)

    return score


def text_scorer(slope: float = 8.0, intercept: float = -4.0) -> Scorer:
    """Logit of the byte-set similarity of the two texts, as a plain expression."""

    def score(df: DataFrame) -> DataFrame:
        compared = with_byte_similarity(df, "_similar", F.col("left_text"), F.col("right_text"))
        return compared.withColumn(
            "logit", F.lit(intercept) + F.lit(slope) * F.col("_similar")
        ).drop("_similar")

    return score


def batch_scorer(score_batch: Callable[[pd.DataFrame], pd.Series]) -> Scorer:
    """A caller's model on Arrow batches of rows with similar text lengths.

    ``score_batch`` gets a frame with ``left_text`` and ``right_text`` and returns logits;
    load a model lazily inside it.
    """

    def score(df: DataFrame) -> DataFrame:
        schema = T.StructType([*df.schema.fields, T.StructField("logit", T.DoubleType())])

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield frame.assign(logit=score_batch(frame).astype("float64"))

        lengths = F.length("left_text") + F.length("right_text")
        return df.sortWithinPartitions(lengths).mapInPandas(run, schema)

    return score


def score_pairs(pairs: DataFrame, scorer: Scorer, bidirectional: bool = False) -> DataFrame:
    """Add ``score``: the scorer's logit, or the mean over both text orders.

    Both orders are rows of one table, so the scorer runs once over them.
    """
    if not bidirectional:
        return scorer(pairs).withColumnRenamed("logit", "score")
    both = pairs.withColumn(
        "_orders",
        F.array(
            F.struct(F.lit(0).alias("_order"), F.col("left_text").alias("l"), F.col("right_text").alias("r")),
            F.struct(F.lit(1).alias("_order"), F.col("right_text").alias("l"), F.col("left_text").alias("r")),
        ),
    ).select("id1", "id2", F.inline("_orders"))
    turned = both.withColumnsRenamed({"l": "left_text", "r": "right_text"})
    logits = (
        scorer(turned)
        .groupBy("id1", "id2")
        .agg(
            F.max(F.when(F.col("_order") == 0, F.col("logit"))).alias("_forward"),
            F.max(F.when(F.col("_order") == 1, F.col("logit"))).alias("_backward"),
        )
    )
    return pairs.join(logits, ["id1", "id2"]).select(
        *pairs.columns, ((F.col("_forward") + F.col("_backward")) * 0.5).alias("score")
    )


def score_directions(prompts: DataFrame, scorer: Scorer) -> DataFrame:
    """Forward, backward and mean logit per pair from prompts of both directions."""
    scored = scorer(prompts)
    forward = F.max(F.when(F.col("direction") == "forward", F.col("logit")))
    backward = F.max(F.when(F.col("direction") == "backward", F.col("logit")))
    both = scored.groupBy("id1", "id2").agg(
        forward.alias("teacher_logit_forward"), backward.alias("teacher_logit_backward")
    )
    mean = (F.col("teacher_logit_forward") + F.col("teacher_logit_backward")) * 0.5
    return both.withColumn("teacher_logit", mean).withColumn(
        "teacher_probability", logistic(F.col("teacher_logit"))
    )
