"""Grouped ranking and probability metrics."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairmatch.functions.numeric import (
    clip,
    majority_positive,
    soft_cross_entropy,
    unanimous,
)
from pairmatch.operators.ranking import range_sorted, running_sums, with_required
from pairmatch.session import settle, shuffle_width


def cohort_precision(
    df: DataFrame,
    keys: Sequence[str],
    score: Column,
    target: Column,
    cohorts: Mapping[str, Column],
    slots: int | None = None,
) -> DataFrame:
    """Average precision of every cohort of every group, in one pass over the ranking.

    A cohort is a row mask (a fold, all other folds, a stress slice). Rows of one group,
    score and set of cohorts are two counters, so rows are neither copied per cohort nor
    ranked more than once, and tied scores collapse to one threshold. The counters are dealt
    by one range shuffle and sorted; a task runs through them once and hands on three sums per
    group and cohort. Returns ``keys, cohort, rows, positives, average_precision`` for
    non-empty cohorts; a cohort without positives scores 0. A null key, and a null or NaN
    score, fail the job.
    """
    marked = with_cohort_sets(df, cohorts).withColumns(
        {"_score": score, "_n": F.lit(1).cast("bigint"), "_p": F.coalesce(target == F.lit(1), F.lit(False)).cast("bigint")}
    )
    return cell_precision(marked, keys, cohorts, slots)


def _words(cohorts: Mapping[str, Column]) -> list[str]:
    """Columns of the sets of cohorts as bits, 62 to a number."""
    return [f"_in{w}" for w in range(-(-len(cohorts) // 62))]


def with_cohort_sets(df: DataFrame, cohorts: Mapping[str, Column]) -> DataFrame:
    """Add the cohorts of every row as bits."""
    bits = [F.when(mask, F.lit(1 << (i % 62))).otherwise(F.lit(0)).cast("bigint") for i, mask in enumerate(cohorts.values())]
    return df.withColumns(
        {name: reduce(lambda x, y: x + y, bits[62 * w : 62 * (w + 1)]) for w, name in enumerate(_words(cohorts))}
    )


def cohort_cells(
    df: DataFrame, keys: Sequence[str], values: Sequence[str], target: Column, cohorts: Mapping[str, Column]
) -> DataFrame:
    """``keys, values``, sets of cohorts and two counters, for rows that ``cell_precision`` ranks by several scores.

    Equal rows are one cell before they are copied once per score, not after; the cells are
    dealt evenly over all tasks.
    """
    marked = with_cohort_sets(df, cohorts).withColumn("_hit", target == F.lit(1))
    cells = marked.groupBy(*keys, *values, *_words(cohorts)).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if("_hit").alias("_p")
    )
    return cells.repartition(shuffle_width(df.sparkSession))


def cell_precision(
    cells: DataFrame, keys: Sequence[str], cohorts: Mapping[str, Column], slots: int | None = None
) -> DataFrame:
    """``cohort_precision`` of cells that carry ``_score``, their sets of cohorts, rows ``_n`` and positives ``_p``."""
    names, sets = list(cohorts), _words(cohorts)
    scored = cells.select(*keys, F.col("_score").cast("double").alias("_score"), *sets, "_n", "_p")
    cells = (
        with_required(scored, keys, ["_score"])
        .where(F.greatest(*[F.col(c) for c in (*sets, *sets)]) > 0)
        .groupBy(*keys, "_score", *sets)
        .agg(F.sum("_n").alias("_n"), F.sum("_p").alias("_p"))
        .withColumn("_score", -F.col("_score"))
    )
    rows = settle(range_sorted(cells, keys, ["_score"], slots))
    partial = rows.mapInArrow(
        _precision_sums(keys, len(names), _carried(rows, keys, sets, len(names))),
        T.StructType(
            [
                *(rows.schema[k] for k in keys),
                T.StructField("_cohort", T.IntegerType()),
                T.StructField("rows", T.LongType()),
                T.StructField("positives", T.LongType()),
                T.StructField("_gain", T.DoubleType()),
            ]
        ),
    )
    named = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_cohort") + 1)
    return (
        partial.groupBy(*keys, "_cohort")
        .agg(F.sum("rows").alias("rows"), F.sum("positives").alias("positives"), F.sum("_gain").alias("_gain"))
        .where("rows > 0")
        .select(
            *keys,
            named.alias("cohort"),
            "rows",
            "positives",
            F.when(F.col("positives") > 0, F.col("_gain") / F.col("positives"))
            .otherwise(F.lit(0.0))
            .alias("average_precision"),
        )
    )


def _carried(rows: DataFrame, keys: Sequence[str], sets: Sequence[str], cohorts: int) -> dict[int, list[int]]:
    """Rows and positives per cohort that the first group of a partition has in earlier ones.

    One entry per partition that a group runs into; the partitions' own sums are combined
    map-side, so what reaches the driver doesn't grow with the rows.
    """
    spread = rows
    if keys:
        # Keys ascend, so a partition's first group has the least keys.
        heads = rows.groupBy("_part").agg(F.min(F.struct(*keys)).alias("_first"))
        first = heads.select("_part", *[F.col(f"_first.`{k}`").alias(k) for k in keys])
        spread = rows.join(first.select(*keys).distinct(), list(keys), "left_semi")
    counters = [
        F.sum(F.when(F.col(sets[i // 62]).bitwiseAND(F.lit(1 << (i % 62)).cast("bigint")) != 0, F.col(c)).otherwise(0))
        for i in range(cohorts)
        for c in ("_n", "_p")
    ]
    cells = spread.groupBy(*keys, "_part").agg(*[c.alias(f"_c{j}") for j, c in enumerate(counters)])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = cells.select(
        *keys, "_part", F.array(*[F.sum(f"_c{j}").over(before) for j in range(2 * cohorts)]).alias("_before")
    ).where("_before[0] is not null")
    if keys:
        sums = sums.join(first, ["_part", *keys], "left_semi")
    return {r["_part"]: r["_before"] for r in sums.select("_part", "_before").collect()}


def _precision_sums(keys: Sequence[str], cohorts: int, carried: Mapping[int, Sequence[int]]):
    """Streaming pass over sorted cells: rows, positives and gain per group, cohort and batch."""
    width = len(keys)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        state = {"group": None, "sums": np.zeros((2 * cohorts, 1))}

        def summed(batch, begins):
            """All thresholds of ``batch``, which ends with one; ``begins`` marks their first cells."""
            ties = np.flatnonzero(begins)
            news = np.zeros(batch.num_rows, bool)
            for k in range(width):
                column = batch.column(k)
                news[1:] |= pc.not_equal(column.slice(1), column.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
            news[0] = [batch.column(k)[0].as_py() for k in range(width)] != state["group"]
            counts = [batch.column(c).to_numpy() for c in ("_n", "_p")]
            sets = [batch.column(f"_in{w}").to_numpy() for w in range(-(-cohorts // 62))]
            per_tie = np.empty((2 * cohorts, len(ties)))
            for i in range(cohorts):
                own = (sets[i // 62] >> (i % 62)) & 1
                for j, count in enumerate(counts):
                    per_tie[2 * i + j] = np.add.reduceat(count * own, ties)
            group = np.flatnonzero(news[ties])
            starts = group if len(group) and group[0] == 0 else np.concatenate([[0], group])
            ran = np.cumsum(per_tie, axis=1)
            base = np.concatenate([np.zeros((2 * cohorts, 1)), ran], axis=1)[:, starts]
            if not (len(group) and group[0] == 0):
                base[:, 0] -= state["sums"][:, 0]
            ran -= np.repeat(base, np.diff(np.append(starts, len(ties))), axis=1)
            state["sums"] = ran[:, -1:].copy()
            state["group"] = [batch.column(k)[batch.num_rows - 1].as_py() for k in range(width)]
            hits, seen = per_tie[1::2], ran[::2]
            gain = np.divide(hits * ran[1::2], seen, out=np.zeros_like(hits), where=hits > 0)
            firsts = pa.array(np.repeat(ties[starts], cohorts))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(k).take(firsts) for k in range(width)),
                    pa.array(np.tile(np.arange(cohorts, dtype=np.int32), len(starts))),
                    pa.array(np.add.reduceat(per_tie[::2], starts, axis=1).T.ravel().astype(np.int64)),
                    pa.array(np.add.reduceat(hits, starts, axis=1).T.ravel().astype(np.int64)),
                    pa.array(np.add.reduceat(gain, starts, axis=1).T.ravel()),
                ],
                names=[*keys, "_cohort", "rows", "positives", "_gain"],
            )

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is None:
                part = batch.column("_part")[0].as_py()
                if part in carried:
                    state["group"] = [batch.column(k)[0].as_py() for k in range(width)]
                    state["sums"] = np.array(carried[part], float)[:, None]
            else:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            # Cells of one threshold lie side by side; the last one may go on in the next batch.
            begins = np.ones(batch.num_rows, bool)
            begins[1:] = False
            for k in range(width + 1):
                column = batch.column(k)
                begins[1:] |= pc.not_equal(column.slice(1), column.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
            last = int(np.flatnonzero(begins)[-1])
            if last:
                yield from summed(batch.slice(0, last), begins[:last])
            held = batch.slice(last)
        if held is not None:
            begins = np.zeros(held.num_rows, bool)
            begins[0] = True
            yield from summed(held, begins)

    return run


def average_precision(
    df: DataFrame, keys: Sequence[str], score: str = "score", target: str = "target"
) -> DataFrame:
    """Average precision, rows and positives per group."""
    return cohort_precision(
        df, keys, F.col(score), F.col(target), {"all": F.lit(True)}
    ).drop("cohort")


def macro(by_category: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Unweighted mean of per-category average precision."""
    return by_category.groupBy(*keys).agg(
        F.avg("average_precision").alias("macro_average_precision"),
        F.count(F.lit(1)).alias("categories"),
        F.sum("rows").alias("rows"),
        F.sum("positives").alias("positives"),
    )


STRESS = ("hard_negative", "hard_positive", "identity_conflict")


def stress_cohorts(target: Column | None = None) -> dict[str, Column]:
    """Challenge slices from category thresholds joined onto the rows.

    Each keeps one class whole and only the difficult rows of the other.
    """
    positive = (F.col("target") if target is None else target) == 1
    similarity = F.col("surface_similarity")
    return {
        "hard_negative": positive | (similarity >= F.col("hard_negative_min_similarity")),
        "hard_positive": ~positive | (similarity <= F.col("hard_positive_max_similarity")),
        "identity_conflict": positive | (F.col("identity_conflicts") > 0),
    }


def eligible(by_category: DataFrame) -> DataFrame:
    """Mark the categories that hold both classes; the others are excluded from a mean."""
    return by_category.withColumn(
        "eligible", (F.col("positives") > 0) & (F.col("positives") < F.col("rows"))
    )


def challenge_report(
    by_category: DataFrame, keys: Sequence[str] = ("cohort",), expected_categories: int | None = None
) -> DataFrame:
    """Macro average precision over eligible categories, and the excluded ones.

    With ``expected_categories`` a cohort with another number of eligible ones fails the job.
    """
    report = _challenge_report(by_category, keys)
    if expected_categories is None:
        return report
    wrong = F.raise_error(
        F.concat(
            F.lit("eligible categories: "), F.col("eligible_categories").cast("string"),
            F.lit(f" instead of {expected_categories}, without "), F.col("excluded_categories"),
        )
    )
    counted = F.when(F.col("eligible_categories") != expected_categories, wrong).otherwise(F.col("eligible_categories"))
    return report.withColumn("eligible_categories", counted.cast("bigint"))


def _challenge_report(by_category: DataFrame, keys: Sequence[str]) -> DataFrame:
    marked = eligible(by_category)
    return marked.groupBy(*keys).agg(
        F.avg(F.when(F.col("eligible"), F.col("average_precision"))).alias(
            "macro_average_precision"
        ),
        F.count_if("eligible").alias("eligible_categories"),
        F.array_join(
            F.array_sort(F.collect_list(F.when(~F.col("eligible"), F.col("category")))), ","
        ).alias("excluded_categories"),
        F.sum(F.when(F.col("eligible"), F.col("rows"))).alias("rows"),
        F.sum(F.when(F.col("eligible"), F.col("positives"))).alias("positives"),
    )


def spearman(df: DataFrame, keys: Sequence[str], left: str, right: str) -> DataFrame:
    """Rank correlation with average ranks per group; null for a constant column.

    Works on distinct (left, right) cells. The mean average-rank is (n + 1) / 2, so the
    correlation is a ratio of three weighted sums.
    """
    cells = (
        with_required(df.select(*keys, *dict.fromkeys((left, right))), keys, [left, right])
        .groupBy(*keys, left, right)
        .agg(F.count(F.lit(1)).alias("_cell"))
    )

    def ranks(value: str, out: str) -> DataFrame:
        per_value = cells.groupBy(*keys, value).agg(F.sum("_cell").alias("_n"))
        ran = running_sums(per_value, keys, F.col(value), ["_n"])
        return ran.select(
            *keys,
            value,
            (
                F.col("_n_upto") - F.col("_n") + (F.col("_n") + 1) / F.lit(2.0)
                - (F.col("_n_total") + 1) / F.lit(2.0)
            ).alias(out),
        )

    centred = cells.join(ranks(left, "_l"), [*keys, left]).join(ranks(right, "_r"), [*keys, right])
    sums = centred.groupBy(*keys).agg(
        F.sum("_cell").alias("rows"),
        F.sum(F.col("_cell") * F.col("_l") * F.col("_r")).alias("_lr"),
        F.sum(F.col("_cell") * F.col("_l") * F.col("_l")).alias("_ll"),
        F.sum(F.col("_cell") * F.col("_r") * F.col("_r")).alias("_rr"),
    )
    spread = F.sqrt(F.col("_ll")) * F.sqrt(F.col("_rr"))
    return sums.select(
        *keys, "rows", F.when(spread > 0, F.col("_lr") / spread).alias("spearman")
    )


def macro_spearman(df: DataFrame, left: str, right: str, category: str = "category") -> DataFrame:
    per_category = spearman(df, [category], left, right)
    return per_category.agg(
        F.avg("spearman").alias("macro_spearman"),
        F.count(F.lit(1)).alias("categories"),
        F.count_if(F.col("spearman").isNull()).alias("undefined_categories"),
    )


def soft_label_report(df: DataFrame, score: str, target: str) -> DataFrame:
    """Majority and unanimous macro average precision, rank agreement, unanimous rows."""
    soft = F.col(target)
    ranked = cohort_precision(
        df,
        ["category"],
        F.col(score),
        majority_positive(soft).cast("int"),
        {"majority": F.lit(True), "unanimous": unanimous(soft)},
    )
    per_cohort = ranked.groupBy().agg(
        *[
            F.avg(F.when(F.col("cohort") == c, F.col("average_precision"))).alias(
                f"{c}_macro_average_precision"
            )
            for c in ("majority", "unanimous")
        ],
        F.sum(F.when(F.col("cohort") == "unanimous", F.col("rows"))).alias("unanimous_rows"),
    )
    agreement = macro_spearman(df, score, target).select("macro_spearman")
    return per_cohort.select("*", agreement.scalar().alias("soft_macro_spearman"))


def probability_report(
    df: DataFrame, variants: Mapping[str, Column], target: str = "target"
) -> DataFrame:
    """Brier score, log loss, mean probability and positive rate per variant."""
    label = F.col(target)
    clipped = {
        name: clip(p, 1e-7, 1.0 - 1e-7) for name, p in variants.items()
    }
    row = df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("variant"),
                    F.avg((p - label) * (p - label)).alias("brier"),
                    F.avg(-(label * F.log(p) + (1.0 - label) * F.log(1.0 - p))).alias("log_loss"),
                    F.avg(p).alias("mean_probability"),
                    F.avg(label).alias("positive_rate"),
                )
                for name, p in clipped.items()
            ]
        ).alias("_variants")
    )
    return row.select(F.inline("_variants"))


def weighted_cross_entropy(
    df: DataFrame,
    logit: str,
    target: str,
    category_weights: DataFrame | None = None,
    confidence_gamma: float = 0.0,
) -> DataFrame:
    """Soft cross-entropy weighted by category and label confidence, normalised.

    A weight sum of zero or a category without a weight fails the job.
    """
    if confidence_gamma < 0.0:
        raise ValueError("confidence_gamma must not be negative")
    weight = F.lit(1.0)
    if category_weights is not None:
        df = df.join(category_weights.select("category", "weight"), "category", "left")
        known = F.col("weight")
        missing = F.raise_error(F.concat(F.lit("no weight for category "), F.col("category")))
        weight = F.coalesce(known, missing.cast("double"))
    if confidence_gamma:
        weight = weight * F.pow(F.abs(2.0 * F.col(target) - 1.0), F.lit(confidence_gamma))
    rows = df.select(
        weight.alias("_w"), soft_cross_entropy(F.col(logit), F.col(target)).alias("_l")
    )
    sums = rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("_w").alias("weight_sum"),
        F.sum(F.col("_l") * F.col("_w")).alias("_loss"),
    )
    refused = F.raise_error(F.lit("the loss weights have no positive sum")).cast("double")
    return sums.select(
        "rows",
        "weight_sum",
        F.when(F.col("weight_sum") > 0, F.col("_loss") / F.col("weight_sum"))
        .otherwise(refused)
        .alias("loss"),
    )


def agreement(
    expected: DataFrame,
    actual: DataFrame,
    key: str,
    min_spearman: float = 0.999,
    min_sign_agreement: float = 0.99,
    max_mean_delta: float = 0.005,
) -> DataFrame:
    """Rescoring agreement of two scored tables on one key, with a verdict."""
    both = expected.select(
        key, F.col("logit").alias("_el"), F.col("probability").alias("_ep")
    ).join(
        actual.select(key, F.col("logit").alias("_al"), F.col("probability").alias("_ap")),
        key,
        "full_outer",
    )
    delta = F.abs(F.col("_ep") - F.col("_ap"))
    row = both.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("_el").isNull() | F.col("_al").isNull()).alias("uncovered_rows"),
        F.avg(((F.col("_el") >= 0) == (F.col("_al") >= 0)).cast("double")).alias("sign_agreement"),
        F.avg(delta).alias("mean_abs_delta"),
        F.max(delta).alias("max_abs_delta"),
    )
    matched = both.where("_el is not null and _al is not null").withColumn("_one", F.lit(1))
    correlation = spearman(matched, ["_one"], "_el", "_al").select("spearman")
    return row.select("*", correlation.scalar().alias("spearman")).withColumn(
        "passed",
        (F.col("uncovered_rows") == 0)
        & (F.col("spearman") >= min_spearman)
        & (F.col("sign_agreement") >= min_sign_agreement)
        & (F.col("mean_abs_delta") <= max_mean_delta),
    )
