"""Ranking and probability metrics, ranks, thresholds and category weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairmatch.catalogue.registry import (
    STRESS_SQL,
    THRESHOLDS_SQL,
    average_rank_sql,
    precision_sql,
    query,
    real,
    spearman_sql,
    whole,
)
from pairmatch.functions.numeric import logistic
from pairmatch.operators import metrics, ranking, summaries
from pairmatch.operators.joins import (
    pair_join,
    with_category_parameters,
    with_surface_similarity,
)
from pairmatch.sources import views
from pairmatch.sources.tables import fold_filter

FOLDS = (0, 1, 2, 3, 4)
THRESHOLDS = ("hard_negative_min_similarity", "hard_positive_max_similarity")


def stressed(spark, sf_dir):
    scored = views.scored(spark, sf_dir)
    return with_category_parameters(scored, summaries.hard_pair_thresholds(scored), THRESHOLDS)


_NAMES_SQL = """named AS (SELECT p.id1, p.id2, p.target, a.category, b.category AS right_category,
  lower(coalesce(a.name, '')) AS ln, lower(coalesce(b.name, '')) AS rn,
  a.name AS left_name, b.name AS right_name
  FROM {pairs} p JOIN items a ON a.id = p.id1 JOIN items b ON b.id = p.id2)"""
_SIMILARITY_SQL = """CAST(CASE WHEN length(ln) = 0 OR length(rn) = 0 THEN 0.0
  WHEN length(ln) < 2 OR length(rn) < 2 THEN CAST(ln = rn AS DOUBLE)
  ELSE jaccard(ln, rn) END AS FLOAT)"""


def lexical(spark, sf_dir):
    """Human pairs with the similarity of their names as the score."""
    joined = pair_join(views.human_pairs(spark, sf_dir), views.items(spark, sf_dir), ["name"])
    return with_surface_similarity(joined, "score")


_LEXICAL_SQL = (
    _NAMES_SQL.format(pairs="human_pairs"),
    f"lexical AS (SELECT category, target, {_SIMILARITY_SQL} AS score FROM named)",
)


@query(
    views.with_views(
        ["human_pairs"],
        *_LEXICAL_SQL,
        precision_sql("lexical", ["category"], "score", {"all": "true"}),
        query=f"""SELECT category, rows, positives,
        {real('average_precision', 'average_precision')} FROM ap""",
    )
)
def lexical_average_precision(spark, sf_dir):
    return metrics.average_precision(lexical(spark, sf_dir), ["category"])


@query(
    views.with_views(
        ["human_pairs"],
        *_LEXICAL_SQL,
        precision_sql("lexical", ["category"], "score", {"all": "true"}),
        query=f"""SELECT {real('avg(average_precision)', 'macro_average_precision')},
        count(*) AS categories, {whole('sum(rows)', 'rows')},
        {whole('sum(positives)', 'positives')} FROM ap""",
    )
)
def lexical_macro_average_precision(spark, sf_dir):
    return metrics.macro(lexical_average_precision(spark, sf_dir))


@query(
    views.with_views(
        ["scored"],
        precision_sql("scored", ["category"], "score_a", {"all": "true"}),
        query=f"""SELECT category, rows, positives,
        {real('average_precision', 'average_precision')} FROM ap""",
    )
)
def average_precision_by_category(spark, sf_dir):
    return metrics.average_precision(views.scored(spark, sf_dir), ["category"], "score_a")


@query(
    views.with_views(
        ["scored"],
        precision_sql("scored", ["category"], "score_c", {"all": "true"}),
        query=f"""SELECT {real('avg(average_precision)', 'macro_average_precision')},
        count(*) AS categories, {whole('sum(rows)', 'rows')},
        {whole('sum(positives)', 'positives')} FROM ap""",
    )
)
def macro_average_precision(spark, sf_dir):
    """Heavily tied scores: 26 distinct values."""
    scored = views.scored(spark, sf_dir)
    return metrics.macro(metrics.average_precision(scored, ["category"], "score_c"))


_FOLD_COHORTS = {"all_folds": "true", "folds_1_4": "fold <> 0"} | {
    f"fold_{f}": f"fold = {f}" for f in FOLDS
}


@query(
    views.with_views(
        ["scored"],
        precision_sql("scored", ["category"], "score_b", _FOLD_COHORTS),
        query=f"""SELECT cohort, {real('avg(average_precision)', 'macro_average_precision')},
        count(*) AS categories, {whole('sum(rows)', 'rows')},
        {whole('sum(positives)', 'positives')} FROM ap GROUP BY cohort""",
    )
)
def metric_by_fold(spark, sf_dir):
    cohorts = {"all_folds": F.lit(True), "folds_1_4": F.col("fold") != 0}
    cohorts |= {f"fold_{f}": F.col("fold") == f for f in FOLDS}
    ranked = metrics.cohort_precision(
        views.scored(spark, sf_dir), ["category"], F.col("score_b"), F.col("target"), cohorts
    )
    return metrics.macro(ranked, ["cohort"])


@query(
    views.with_views(
        ["scored"],
        spearman_sql("scored", ["category"], "score_a", "soft_target", "sp"),
        query=f"SELECT category, rows, {real('spearman', 'spearman')} FROM sp",
    )
)
def spearman_by_category(spark, sf_dir):
    return metrics.spearman(views.scored(spark, sf_dir), ["category"], "score_a", "soft_target")


@query(
    views.with_views(
        ["scored"],
        spearman_sql("scored", ["category"], "score_a", "score_b", "sp"),
        query=f"""SELECT {real('avg(spearman)', 'macro_spearman')}, count(*) AS categories,
        count(*) FILTER (WHERE spearman IS NULL) AS undefined_categories FROM sp""",
    )
)
def macro_spearman(spark, sf_dir):
    return metrics.macro_spearman(views.scored(spark, sf_dir), "score_a", "score_b")


@query(
    views.with_views(
        ["scored"],
        "soft AS (SELECT *, CASE WHEN soft_target >= CAST(5 AS DOUBLE) / 9 THEN 1 ELSE 0 END AS y"
        " FROM scored)",
        precision_sql(
            "soft",
            ["category"],
            "score_a",
            {"majority": "true", "unanimous": "soft_target IN (0, 1)"},
            target="y",
        ),
        spearman_sql("scored", ["category"], "score_a", "soft_target", "sp"),
        query=f"""SELECT
        {real("avg(average_precision) FILTER (WHERE cohort = 'majority')",
              'majority_macro_average_precision')},
        {real("avg(average_precision) FILTER (WHERE cohort = 'unanimous')",
              'unanimous_macro_average_precision')},
        {whole("sum(rows) FILTER (WHERE cohort = 'unanimous')", 'unanimous_rows')},
        (SELECT round(avg(spearman), 9) + 0 FROM sp) AS soft_macro_spearman FROM ap""",
    )
)
def soft_label_validation(spark, sf_dir):
    return metrics.soft_label_report(views.scored(spark, sf_dir), "score_a", "soft_target")


_WEIGHTS_SQL = """weights AS (SELECT category, CAST(sum(count(*)) OVER () AS DOUBLE)
  / (count(*) OVER () * count(*)) AS weight FROM scored GROUP BY category)"""


@query(
    views.with_views(
        ["scored"],
        _WEIGHTS_SQL,
        """losses AS (SELECT w.weight * abs(2 * soft_target - 1) ** 1.5 AS w,
        greatest(score_a, 0) - score_a * soft_target + ln(1 + exp(-abs(score_a))) AS l
        FROM scored JOIN weights w USING (category))""",
        query=f"""SELECT count(*) AS rows, {real('avg(w)', 'mean_weight')},
        {real('sum(w * l) / sum(w)', 'loss')} FROM losses""",
    )
)
def weighted_bce(spark, sf_dir):
    scored = views.scored(spark, sf_dir)
    weights = summaries.inverse_category_weights(summaries.category_counts(scored))
    report = metrics.weighted_cross_entropy(scored, "score_a", "soft_target", weights, 1.5)
    return report.select("rows", (F.col("weight_sum") / F.col("rows")).alias("mean_weight"), "loss")


def _probability_sql(expression: str, name: str) -> str:
    return f"""SELECT '{name}' AS variant, {real('avg((p - y) * (p - y))', 'brier')},
    {real('avg(-(y * ln(p) + (1 - y) * ln(1 - p)))', 'log_loss')},
    {real('avg(p)', 'mean_probability')}, {real('avg(y)', 'positive_rate')}
    FROM (SELECT target AS y, greatest(least({expression}, 1 - 1e-7), 1e-7) AS p FROM scored)"""


@query(
    views.with_views(
        ["scored"],
        query=_probability_sql("1 / (1 + exp(-greatest(least(score_a, 40), -40)))", "plain")
        + " UNION ALL "
        + _probability_sql("1 / (1 + exp(-greatest(least(50 * score_b - 25, 40), -40)))", "steep"),
    )
)
def brier_log_loss(spark, sf_dir):
    variants = {
        "plain": logistic(F.col("score_a")),
        "steep": logistic(F.col("score_b"), 50.0, -25.0),
    }
    return metrics.probability_report(views.scored(spark, sf_dir), variants)


_CHALLENGE_SQL = f"""SELECT cohort,
  {real("avg(average_precision) FILTER (WHERE positives > 0 AND positives < rows)",
        'macro_average_precision')},
  count(*) FILTER (WHERE positives > 0 AND positives < rows) AS eligible_categories,
  coalesce(string_agg(category, ',' ORDER BY category)
    FILTER (WHERE NOT (positives > 0 AND positives < rows)), '') AS excluded_categories,
  {whole("sum(rows) FILTER (WHERE positives > 0 AND positives < rows)", 'rows')},
  {whole("sum(positives) FILTER (WHERE positives > 0 AND positives < rows)", 'positives')}
  FROM ap GROUP BY cohort"""


@query(
    views.with_views(
        ["scored"],
        THRESHOLDS_SQL,
        precision_sql("stressed", ["category"], "score_a", STRESS_SQL),
        query=_CHALLENGE_SQL,
    )
)
def stress_suite(spark, sf_dir):
    ranked = metrics.cohort_precision(
        stressed(spark, sf_dir),
        ["category"],
        F.col("score_a"),
        F.col("target"),
        metrics.stress_cohorts(),
    )
    return metrics.challenge_report(ranked)


@query(
    views.with_views(
        ["scored"],
        THRESHOLDS_SQL,
        precision_sql("stressed", ["fold", "category"], "score_b", STRESS_SQL),
        query=f"""SELECT fold, cohort, {real('avg(average_precision)', 'macro_average_precision')},
        count(*) AS categories, {whole('sum(rows)', 'rows')},
        {whole('sum(positives)', 'positives')} FROM ap GROUP BY fold, cohort""",
    )
)
def oof_stress_scores(spark, sf_dir):
    ranked = metrics.cohort_precision(
        stressed(spark, sf_dir),
        ["fold", "category"],
        F.col("score_b"),
        F.col("target"),
        metrics.stress_cohorts(),
    )
    return metrics.macro(ranked, ["fold", "cohort"])


@query(
    views.with_views(
        ["scored"],
        THRESHOLDS_SQL,
        query=f"""SELECT count(*) FILTER (WHERE target <> 1
            AND surface_similarity >= hard_negative_min_similarity) AS hard_negative_rows,
        count(*) FILTER (WHERE target = 1
            AND surface_similarity <= hard_positive_max_similarity) AS hard_positive_rows,
        count(*) FILTER (WHERE target <> 1 AND identity_conflicts > 0) AS conflict_negative_rows
        FROM stressed""",
    )
)
def stress_slice_counts(spark, sf_dir):
    positive = F.col("target") == 1
    return stressed(spark, sf_dir).agg(
        F.count_if(
            ~positive & (F.col("surface_similarity") >= F.col(THRESHOLDS[0]))
        ).alias("hard_negative_rows"),
        F.count_if(
            positive & (F.col("surface_similarity") <= F.col(THRESHOLDS[1]))
        ).alias("hard_positive_rows"),
        F.count_if(~positive & (F.col("identity_conflicts") > 0)).alias("conflict_negative_rows"),
    )


@query(
    views.with_views(
        ["scored"],
        THRESHOLDS_SQL,
        query=f"""SELECT category,
        {real('hard_negative_min_similarity', 'hard_negative_min_similarity')},
        {real('hard_positive_max_similarity', 'hard_positive_max_similarity')},
        negative_candidates, positive_candidates FROM thresholds""",
    )
)
def hard_pair_thresholds(spark, sf_dir):
    return summaries.hard_pair_thresholds(views.scored(spark, sf_dir))


@query(
    views.with_views(
        ["scored"],
        "training AS (SELECT * FROM scored WHERE fold <> 1)",
        query=f"""SELECT category,
        {real("quantile_cont(surface_similarity, 0.75) FILTER (WHERE target <= 0.2)",
              'hard_negative_min_similarity')},
        {real("quantile_cont(surface_similarity, 0.25) FILTER (WHERE target >= 0.8)",
              'hard_positive_max_similarity')},
        count(*) FILTER (WHERE target <= 0.2) AS negative_candidates,
        count(*) FILTER (WHERE target >= 0.8) AS positive_candidates
        FROM training GROUP BY category""",
    )
)
def hard_pair_thresholds_fold(spark, sf_dir):
    training = fold_filter(views.scored(spark, sf_dir), exclude_fold=1)
    return summaries.hard_pair_thresholds(training)


@query(
    views.with_views(
        ["scored"],
        query=f"""SELECT category, count(*) AS rows,
        {real('CAST(sum(count(*)) OVER () AS DOUBLE) / (count(*) OVER () * count(*))', 'weight')}
        FROM scored GROUP BY category""",
    )
)
def inverse_category_weights(spark, sf_dir):
    counts = summaries.category_counts(views.scored(spark, sf_dir))
    return summaries.inverse_category_weights(counts)


@query(
    views.with_views(
        ["scored"],
        query="SELECT category, count(*) AS rows FROM scored WHERE fold <> 2 GROUP BY category",
    )
)
def category_counts(spark, sf_dir):
    return summaries.category_counts(views.scored(spark, sf_dir).where("fold <> 2"))


@query(
    views.with_views(
        ["scored"],
        query=f"""SELECT id1, id2, {real(average_rank_sql(['category'], 'score_c'), 'rank')},
        count(*) OVER (PARTITION BY category) AS size FROM scored""",
    )
)
def average_rank(spark, sf_dir):
    ranked = ranking.average_ranks(
        views.scored(spark, sf_dir), ["category"], "score_c", "rank", "size"
    )
    return ranked.select("id1", "id2", "rank", "size")


@query(
    views.with_views(
        ["scored"],
        query=f"""SELECT id1, id2, {real(average_rank_sql(['category', 'fold'], 'score_a')
            + '/ (count(*) OVER (PARTITION BY category, fold) + 1)', 'a_rank')},
        {real(average_rank_sql(['category', 'fold'], 'score_c')
            + '/ (count(*) OVER (PARTITION BY category, fold) + 1)', 'c_rank')} FROM scored""",
    )
)
def percentile_rank_fold(spark, sf_dir):
    return ranking.percentile_ranks(
        views.scored(spark, sf_dir),
        ["category", "fold"],
        {"score_a": "a_rank", "score_c": "c_rank"},
    ).select("id1", "id2", "a_rank", "c_rank")


@query(
    views.with_views(
        ["scored"],
        query=f"""SELECT id1, id2, {real(average_rank_sql(['category'], 'score_b')
            + '/ (count(*) OVER (PARTITION BY category) + 1)', 'b_rank')} FROM scored""",
    )
)
def percentile_rank_category(spark, sf_dir):
    return ranking.percentile_ranks(
        views.scored(spark, sf_dir), ["category"], {"score_b": "b_rank"}
    ).select("id1", "id2", "b_rank")


@query(
    views.with_views(
        ["scored"],
        query=f"""SELECT id1, id2, {real('(' + average_rank_sql(['category'], 'score_a')
            + ' - 1) / greatest(count(*) OVER (PARTITION BY category) - 1, 1)', 'a_rank')}
        FROM scored""",
    )
)
def percentile_rank_zero_one(spark, sf_dir):
    return ranking.percentile_ranks(
        views.scored(spark, sf_dir), ["category"], {"score_a": "a_rank"}, zero_one=True
    ).select("id1", "id2", "a_rank")
