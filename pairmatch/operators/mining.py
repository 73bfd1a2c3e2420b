"""Hard-pair mining: quotas, candidate pools, priorities and corrected replay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairmatch.functions.hashing import seeded_hash
from pairmatch.functions.numeric import corrected_target, target_stratum
from pairmatch.operators.ranking import first_rows, percentile_ranks
from pairmatch.session import publish, settle


def category_quotas(
    categories: DataFrame, weak: Sequence[str], rows: int, weak_fraction: float
) -> DataFrame:
    """``category, quota``: a share for weak categories, the rest for the others.

    Each class splits its share evenly; the remainder goes to its first categories in
    name order. The weak share rounds half to even. Weak names that no category has, a class
    without categories and fewer rows than categories in a class are refused: the quotas
    would not add up to ``rows``, or leave a category without any.
    """
    if not 0.0 < weak_fraction < 1.0:
        raise ValueError("the weak fraction must be inside (0, 1)")
    listed = F.col("category").isin(list(weak))
    found = categories.select("category").distinct().agg(
        F.count_if(listed).alias("weak"), F.count_if(~listed).alias("rest")
    ).first()
    if found["weak"] != len(set(weak)):
        raise ValueError(f"{len(set(weak)) - found['weak']} weak categories are unknown")
    for kind, share in (("weak", round(rows * weak_fraction)), ("rest", rows - round(rows * weak_fraction))):
        if not 0 < found[kind] <= share:
            raise ValueError(f"{share} rows for {found[kind]} categories ({kind})")
    weak_rows = round(rows * weak_fraction)
    names = categories.select("category").distinct()
    marked = names.withColumn("_weak", F.col("category").isin(list(weak)))
    same = Window.partitionBy("_weak")
    share = F.when(F.col("_weak"), F.lit(weak_rows)).otherwise(F.lit(rows - weak_rows))
    size = F.count(F.lit(1)).over(same)
    at = F.row_number().over(same.orderBy("category")) - 1
    quota = F.floor(share / size) + F.when(at < share % size, 1).otherwise(0)
    return marked.select("category", "_weak", quota.cast("bigint").alias("quota")).drop("_weak")


def quota_shortfall(df: DataFrame, quotas: DataFrame) -> DataFrame:
    """``category, quota, available, missing`` of every category named on either side.

    A category of the rows without a quota has a null quota.
    """
    rows = df.groupBy("category").agg(F.count(F.lit(1)).alias("available"))
    both = quotas.select("category", "quota").join(rows, "category", "full_outer")
    available = F.coalesce("available", F.lit(0))
    return both.select(
        "category",
        "quota",
        available.alias("available"),
        F.greatest(F.coalesce("quota", F.lit(0)) - available, F.lit(0)).alias("missing"),
    )


def _complete(df: DataFrame, quotas: DataFrame) -> DataFrame:
    """The quotas; the job fails if one can't be filled or a category of the rows has none."""
    short = F.concat(
        F.lit("category "), F.coalesce("category", F.lit("null")), F.lit(" has "),
        F.col("available").cast("string"), F.lit(" rows for a quota of "),
        F.coalesce(F.col("quota").cast("string"), F.lit("none")),
    )
    bad = F.col("quota").isNull() | (F.col("missing") > 0)
    return quota_shortfall(df, quotas).select(
        "category", F.when(bad, F.raise_error(short)).otherwise(F.col("quota")).alias("quota")
    )


def take_quota(
    df: DataFrame,
    quotas: DataFrame,
    order: Sequence[Column],
    out: str | None = None,
    short: str = "raise",
) -> DataFrame:
    """The first ``quota`` rows of every category in the given order.

    A quota that the rows can't fill, and rows of a category without a quota, fail the job;
    ``short="allow"`` takes what there is.
    """
    if short not in ("raise", "allow"):
        raise ValueError(f"unknown way with short quotas: {short}")
    asked = _complete(df, quotas) if short == "raise" else quotas.select("category", "quota")
    kept = first_rows(df, ["category"], asked, order, out or "_position")
    return kept.select(*df.columns, *([out] if out else []))


def first_per_group(
    df: DataFrame, keys: Sequence[str], rows: int, order: Sequence[Column]
) -> DataFrame:
    """A fixed number of rows per group: a cut per group first, then only its rows are sorted."""
    if rows < 1:
        raise ValueError("rows must be positive")
    quotas = df.select(*keys).distinct().withColumn("quota", F.lit(rows).cast("bigint"))
    return first_rows(df, keys, quotas, order, "_at").select(*df.columns)


def balanced_sample(
    df: DataFrame, rows: int, seed: int, row: str = "source_row", method: str = "md5"
) -> DataFrame:
    """``rows`` pairs per category in hashed order."""
    hashed = seeded_hash(seed, "category", "id1", "id2", row, method=method)
    return first_per_group(df, ["category"], rows, [hashed, F.col(row)])


def candidate_pool(
    joined: DataFrame,
    quotas: DataFrame,
    seed: int = 2026,
    method: str = "md5",
    short: str = "raise",
) -> DataFrame:
    """Round-robin over label strata inside each category, up to its quota (see take_quota).

    Confident negatives come most similar first, confident positives least similar first
    and ambiguous pairs by closeness to one half.
    """
    def pair_hash(offset: int) -> Column:
        return seeded_hash(seed + offset, "id1", "id2", method=method)

    similarity = F.col("surface_similarity").cast("double")
    # One ascending key per stratum; unknown similarities go last.
    urgency = (
        F.when(F.col("candidate_stratum") == 0, -similarity)
        .when(F.col("candidate_stratum") == 1, similarity)
        .otherwise(F.abs(F.col("target") - 0.5))
    )
    labelled = joined.withColumn("candidate_stratum", target_stratum(F.col("target")))
    asked = _complete(joined, quotas) if short == "raise" else quotas.select("category", "quota")
    strata = F.explode(F.array(*[F.lit(i) for i in range(3)]))
    # A row behind its quota inside one stratum cannot make the category's quota.
    eligible = first_rows(
        labelled,
        ["category", "candidate_stratum"],
        asked.withColumn("candidate_stratum", strata),
        [urgency.isNull(), F.coalesce(urgency, F.lit(0.0)), pair_hash(0), F.col("id1"), F.col("id2")],
        "stratum_row",
    )
    order = [
        F.col("stratum_row"),
        F.col("candidate_stratum"),
        pair_hash(1),
        F.col("id1"),
        F.col("id2"),
    ]
    # At most three quotas of rows are left; the round robin numbers those.
    pool = take_quota(publish(eligible), quotas, order, short="allow")
    return pool.drop("stratum_row")


def with_disagreement(df: DataFrame, first: str, second: str) -> DataFrame:
    """Mean and difference of two models' category ranks, priority and suspected error."""
    a, b = F.col(f"{first}_rank"), F.col(f"{second}_rank")
    both = percentile_ranks(
        df, ["category"], {s: f"{s}_rank" for s in (first, second)}, zero_one=True
    )
    ranked = both.withColumn("model_mean_rank", (a + b) * 0.5).withColumn(
        "model_disagreement", F.abs(a - b)
    )
    missed = (1.0 - F.col("target")) * F.col("model_mean_rank")
    spurious = F.col("target") * (1.0 - F.col("model_mean_rank"))
    return ranked.withColumn(
        "teacher_priority", F.greatest(missed, spurious, F.col("model_disagreement") * 0.8)
    ).withColumn(
        "teacher_reason",
        F.when(missed >= spurious, F.lit("possible_false_negative")).otherwise(
            F.lit("possible_false_positive")
        ),
    )


def disagreement_subset(
    df: DataFrame,
    first: str,
    second: str,
    quotas: DataFrame,
    seed: int,
    method: str = "md5",
    short: str = "raise",
) -> DataFrame:
    """The pairs per category where two models and the label disagree most."""
    order = [
        -F.col("teacher_priority"),
        seeded_hash(seed, "id1", "id2", method=method),
        F.col("id1"),
        F.col("id2"),
    ]
    # The quota cut reads the ranked table several times: publish it once.
    return take_quota(settle(with_disagreement(df, first, second)), quotas, order, short=short)


def _share(name: str) -> Column:
    value = F.col(name)
    return F.when(value.between(0.0, 1.0), value).otherwise(F.raise_error(F.lit(f"{name} is not in [0, 1]")))


def corrected_replay(
    df: DataFrame,
    probability: str,
    quotas: DataFrame,
    seed: int,
    teacher_weight: float = 0.8,
    method: str = "md5",
    short: str = "raise",
) -> DataFrame:
    """Pairs a confident teacher corrects most, with the corrected target.

    Targets and probabilities have to lie in [0, 1]; one outside, null or NaN fails the job.
    """
    df = df.withColumns({c: _share(c) for c in ("target", probability)})
    teacher = F.col(probability)
    prepared = (
        df.withColumn("teacher_probability_used", teacher)
        .withColumn("organizer_target", F.col("target"))
        .withColumn("teacher_confidence", 2.0 * F.abs(teacher - 0.5))
        .withColumn("teacher_correction_magnitude", F.abs(teacher - F.col("target")))
        .withColumn(
            "teacher_correction_priority",
            F.col("teacher_confidence") * F.col("teacher_correction_magnitude"),
        )
    )
    order = [
        -F.col("teacher_correction_priority"),
        seeded_hash(seed, "id1", "id2", method=method),
        F.col("id1"),
        F.col("id2"),
    ]
    selected = take_quota(prepared, quotas, order, short=short)
    return selected.withColumn(
        "target",
        corrected_target(
            F.col("organizer_target"), F.col("teacher_probability_used"), teacher_weight
        ),
    )
