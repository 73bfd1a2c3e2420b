"""Teacher prompts for both orders of a pair."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmatch import fixed_values as fixed
from pairmatch.functions.attributes import item_text, with_attributes
from pairmatch.functions.text import with_normalized
from pairmatch.session import spread, unbroadcast


@dataclass(frozen=True)
class PromptTexts:
    """Wording around the two item texts; replace it to suit the teacher model."""

    task: str = "Decide whether both cards describe the same product variant."
    rule: str = "Category rule: "
    first: str = "Card A:"
    second: str = "Card B:"
    answer: str = "Answer 1 for the same product, 0 otherwise."


def teacher_prompts(
    pairs: DataFrame,
    items: DataFrame,
    mode: str = "strict",
    rules: Mapping[str, str] | None = None,
    texts: PromptTexts = PromptTexts(),
    budget: int = fixed.PROMPT_ATTRIBUTE_BUDGET,
) -> DataFrame:
    """Two rows per pair: ``direction`` forward and backward, texts and ``prompt``.

    ``category_rules`` adds the rule of the normalised category, looked up in a literal
    map of the given rules. Prompts never see labels, ids or scores.
    """
    if mode not in ("strict", "category_rules"):
        raise ValueError(f"unsupported prompt mode: {mode}")
    named = with_normalized(
        spread(items.select("id", "category", "name", "attributes")),
        {"_category": F.col("category"), "_name": F.col("name")},
    )
    parsed = with_attributes(named, F.col("attributes"), "_state", "_attributes")
    cards = parsed.select(
        "id",
        "_category",
        item_text(F.col("_category"), F.col("_name"), F.col("_attributes"), budget).alias("text"),
    )
    left = cards.select(F.col("id").alias("id1"), "_category", F.col("text").alias("_left"))
    right = cards.select(F.col("id").alias("id2"), F.col("text").alias("_right"))
    joined = pairs.select("id1", "id2").join(unbroadcast(left), "id1").join(unbroadcast(right), "id2")
    rule = F.lit("")
    if mode == "category_rules":
        for category, text in (rules or {}).items():
            rule = F.when(F.col("_category") == category, F.lit(text)).otherwise(rule)
    block = F.when(rule == "", F.lit("")).otherwise(F.concat(F.lit(f"\n{texts.rule}"), rule))
    turned = joined.select(
        "id1",
        "id2",
        block.alias("_block"),
        F.inline(
            F.array(
                F.struct(
                    F.lit("forward").alias("direction"),
                    F.col("_left").alias("left_text"),
                    F.col("_right").alias("right_text"),
                ),
                F.struct(
                    F.lit("backward").alias("direction"),
                    F.col("_right").alias("left_text"),
                    F.col("_left").alias("right_text"),
                ),
            )
        ),
    )
    prompt = F.concat(
        F.lit(texts.task),
        F.col("_block"),
        F.lit(f"\n\n{texts.first}\n"),
        F.col("left_text"),
        F.lit(f"\n\n{texts.second}\n"),
        F.col("right_text"),
        F.lit(f"\n\n{texts.answer}"),
    )
    return turned.select("id1", "id2", "direction", "left_text", "right_text", prompt.alias("prompt"))
