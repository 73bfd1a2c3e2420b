"""Teacher prompts and scores, calibration, matcher training and ensemble prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairmatch import fixed_values as fixed
from pairmatch.catalogue.quality import _CHALLENGE_SQL
from pairmatch.catalogue.registry import (
    STRESS_SQL,
    average_rank_sql,
    hash_sql,
    precision_sql,
    query,
    real,
    spearman_sql,
)
from pairmatch.catalogue.sampling import BATCH, COMBINED_SQL, SEED
from pairmatch.catalogue.texts import ENTRIES_SQL, evidence_ctes, item_texts_sql
from pairmatch.functions.numeric import logistic
from pairmatch.operators import batches, learning, metrics, splits, summaries
from pairmatch.operators import calibration as C
from pairmatch.operators.joins import with_category
from pairmatch.operators.prompts import PromptTexts, teacher_prompts as build_prompts
from pairmatch.operators.scoring import (
    EVIDENCE_WEIGHTS,
    evidence_scorer,
    evidence_table,
    score_directions,
    score_pairs as run_scorer,
    text_scorer,
)
from pairmatch.plans import ensemble as ENS
from pairmatch.plans import calibration, evaluation
from pairmatch.session import publish, settle, unbroadcast
from pairmatch.sources import views

RULES = {
    "promo": "Promotional bundles must hold the same items.",
    "small": "Sizes must be equal.",
}
TEXTS = PromptTexts()


def _combined(spark, sf_dir):
    return C.combine_directions(views.teacher(spark, sf_dir))


@query(
    views.with_views(
        ["teacher"],
        COMBINED_SQL,
        query=f"""SELECT id1, id2, {real('teacher_logit', 'teacher_logit')},
        {real('teacher_probability', 'teacher_probability')} FROM combined""",
    )
)
def teacher_combine(spark, sf_dir):
    return _combined(spark, sf_dir).select("id1", "id2", "teacher_logit", "teacher_probability")


_RULE_SQL = " ".join(f"WHEN '{c}' THEN chr(10) || '{TEXTS.rule}{r}'" for c, r in RULES.items())
_TURNED_SQL = """turned AS (SELECT p.id1, p.id2, a.category, 'forward' AS direction,
  a.text AS l, b.text AS r FROM soft_pairs p JOIN texts a ON a.id = p.id1 JOIN texts b ON b.id = p.id2
  UNION ALL SELECT p.id1, p.id2, a.category, 'backward', b.text, a.text
  FROM soft_pairs p JOIN texts a ON a.id = p.id1 JOIN texts b ON b.id = p.id2)"""


@query(
    views.with_views(
        ["soft_pairs"],
        ENTRIES_SQL,
        item_texts_sql(fixed.PROMPT_ATTRIBUTE_BUDGET),
        _TURNED_SQL,
        query=f"""SELECT id1, id2, direction, '{TEXTS.task}'
        || CASE lower(category) {_RULE_SQL} ELSE '' END
        || chr(10) || chr(10) || '{TEXTS.first}' || chr(10) || l
        || chr(10) || chr(10) || '{TEXTS.second}' || chr(10) || r
        || chr(10) || chr(10) || '{TEXTS.answer}' AS prompt FROM turned""",
    )
)
def teacher_prompts(spark, sf_dir):
    prompts = build_prompts(
        views.soft_pairs(spark, sf_dir), views.items(spark, sf_dir), "category_rules", RULES
    )
    return prompts.select("id1", "id2", "direction", "prompt")


@query(
    views.with_views(
        ["soft_pairs"],
        ENTRIES_SQL,
        item_texts_sql(fixed.PROMPT_ATTRIBUTE_BUDGET),
        """logits AS (SELECT p.id1, p.id2, -4 + 8 * jaccard(lower(a.text), lower(b.text)) AS f,
        -4 + 8 * jaccard(lower(b.text), lower(a.text)) AS k
        FROM soft_pairs p JOIN texts a ON a.id = p.id1 JOIN texts b ON b.id = p.id2)""",
        query=f"""SELECT id1, id2, {real('f', 'teacher_logit_forward')},
        {real('k', 'teacher_logit_backward')}, {real('(f + k) * 0.5', 'teacher_logit')},
        {real('1 / (1 + exp(-(f + k) * 0.5))', 'teacher_probability')} FROM logits""",
    )
)
def teacher_scores(spark, sf_dir):
    """The whole scoring job: prompts in both directions, mean logit, probability."""
    prompts = build_prompts(views.soft_pairs(spark, sf_dir), views.items(spark, sf_dir))
    return score_directions(prompts, text_scorer())


_FROZEN = {"ECONOMY": (0.8, -0.3), "PROMO": (1.4, 0.2), "SMALL": (0.5, 0.0)}
_FROZEN_SQL = "frozen(category, c, i) AS (VALUES " + ", ".join(
    f"('{k}', {c}, {i})" for k, (c, i) in _FROZEN.items()
) + ")"


def _frozen(spark):
    rows = [(k, c, i) for k, (c, i) in _FROZEN.items()]
    return spark.createDataFrame(rows, "category string, coefficient double, intercept double")


@query(
    views.with_views(
        ["teacher"],
        COMBINED_SQL,
        _FROZEN_SQL,
        query=f"""SELECT id1, id2, category,
        {real('teacher_probability', 'teacher_probability_raw')},
        {real('''CAST(CASE WHEN c IS NULL THEN teacher_probability
          ELSE 1 / (1 + exp(-greatest(least(c * teacher_logit + i, 40), -40))) END AS FLOAT)''',
          'teacher_probability_calibrated')}
        FROM combined LEFT JOIN frozen USING (category)""",
    )
)
def apply_calibration(spark, sf_dir):
    frozen = C.apply_frozen(_combined(spark, sf_dir), _frozen(spark))
    return frozen.select(
        "id1", "id2", "category", "teacher_probability_raw", "teacher_probability_calibrated"
    )


_OVERALL = (0.6, -0.1)
_VARIANTS_SQL = f"""variants AS (SELECT id1, id2, category,
  CASE WHEN target >= CAST(5 AS DOUBLE) / 9 THEN 1 ELSE 0 END AS y, teacher_probability AS raw,
  CASE WHEN category = 'LARGE' THEN teacher_probability ELSE
    1 / (1 + exp(-greatest(least(0.6 * teacher_logit - 0.1, 40), -40))) END AS global_platt,
  CASE WHEN category = 'LARGE' THEN teacher_probability ELSE
    1 / (1 + exp(-greatest(least(coalesce(c, 0.6) * teacher_logit + coalesce(i, -0.1), 40), -40)))
    END AS category_platt
  FROM combined LEFT JOIN frozen USING (category))"""


def _calibrated(spark, sf_dir):
    labelled = _combined(spark, sf_dir).withColumn(
        "target", (F.col("target") >= F.lit(5.0) / F.lit(9.0)).cast("double")
    )
    validated = views.items(spark, sf_dir).where("category <> 'LARGE'").select("category")
    return C.with_calibrations(labelled, _frozen(spark), _OVERALL, validated)


def _variant_sql(name: str, place: int) -> str:
    return f"""SELECT '{name}' AS variant, {place} AS place, avg((p - y) * (p - y)) AS brier,
    avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS log_loss, avg(p) AS mean_probability,
    avg(y) AS positive_rate FROM (SELECT y, greatest(least({name}, 1 - 1e-7), 1e-7) AS p FROM variants)"""


_CHOICE_SQL = "choice AS (" + " UNION ALL ".join(
    _variant_sql(v, i) for i, v in enumerate(C.VARIANTS)
) + ")"


@query(
    views.with_views(
        ["teacher"],
        COMBINED_SQL,
        _FROZEN_SQL,
        _VARIANTS_SQL,
        _CHOICE_SQL,
        query=f"""SELECT variant, {real('brier', 'brier')}, {real('log_loss', 'log_loss')},
        {real('mean_probability', 'mean_probability')}, {real('positive_rate', 'positive_rate')},
        row_number() OVER (ORDER BY log_loss, brier, place) = 1 AS chosen FROM choice""",
    )
)
def choose_calibration(spark, sf_dir):
    return C.calibration_report(_calibrated(spark, sf_dir))


@query(
    views.with_views(
        ["teacher"],
        COMBINED_SQL,
        _FROZEN_SQL,
        _VARIANTS_SQL,
        _CHOICE_SQL,
        "best AS (SELECT variant FROM choice ORDER BY log_loss, brier, place LIMIT 1)",
        query=f"""SELECT id1, id2, {real('''CAST(CASE (SELECT variant FROM best)
        WHEN 'global_platt' THEN global_platt WHEN 'category_platt' THEN category_platt
        ELSE raw END AS FLOAT)''', 'teacher_probability_calibrated')} FROM variants""",
    )
)
def calibrated_probabilities(spark, sf_dir):
    calibrated = settle(_calibrated(spark, sf_dir))
    chosen = C.apply_chosen(calibrated, C.calibration_report(calibrated))
    return chosen.select("id1", "id2", "teacher_probability_calibrated")


_AGREE_SQL = (
    """expected AS (SELECT id1, id2, teacher_logit AS el, teacher_probability AS ep FROM combined)""",
    """rescored AS (SELECT *, el + ((id1 + id2) % 7 - 3) / 100.0 AS al FROM expected)""",
    """both_sides AS (SELECT *, 1 / (1 + exp(-greatest(least(al, 40), -40))) AS ap, 1 AS one
    FROM rescored)""",
)


@query(
    views.with_views(
        ["teacher"],
        COMBINED_SQL,
        *_AGREE_SQL,
        spearman_sql("both_sides", ["one"], "el", "al", "sp"),
        query=f"""SELECT count(*) AS rows, CAST(0 AS BIGINT) AS uncovered_rows,
        {real('avg(CAST((el >= 0) = (al >= 0) AS DOUBLE))', 'sign_agreement')},
        {real('avg(abs(ep - ap))', 'mean_abs_delta')}, {real('max(abs(ep - ap))', 'max_abs_delta')},
        (SELECT round(spearman, 9) FROM sp) AS spearman,
        (SELECT spearman FROM sp) >= 0.999 AND avg(CAST((el >= 0) = (al >= 0) AS DOUBLE)) >= 0.99
          AND avg(abs(ep - ap)) <= 0.005 AS passed FROM both_sides""",
    )
)
def teacher_agreement(spark, sf_dir):
    expected = splits.source_rows(_combined(spark, sf_dir))
    expected = settle(
        expected.select(
            "source_row",
            F.col("teacher_logit").alias("logit"),
            F.col("teacher_probability").alias("probability"),
            "id1",
            "id2",
        )
    )
    shift = (F.pmod(F.col("id1") + F.col("id2"), F.lit(7)) - 3) / F.lit(100.0)
    actual = expected.withColumn("logit", F.col("logit") + shift)
    actual = actual.withColumn("probability", logistic(F.col("logit")))
    return metrics.agreement(expected, actual, "source_row")


def _human(spark, sf_dir):
    pairs = views.human_pairs(spark, sf_dir)
    return evidence_table(pairs, views.items(spark, sf_dir)).drop("left_text", "right_text")


_LOGIT_SQL = " + ".join(
    str(w) if n == "intercept" else f"{w} * CAST({n} AS DOUBLE)" for n, w in EVIDENCE_WEIGHTS.items()
)
_PREDICTED_SQL = (
    *evidence_ctes("human_pairs"),
    """diagnosed AS (SELECT p.id1, p.id2, p.target, a.category, e.identity_matches,
    e.identity_conflicts, e.missing_identity_fields,
    CAST(jaccard(lower(a.name), lower(b.name)) AS FLOAT) AS surface_similarity
    FROM human_pairs p JOIN items a ON a.id = p.id1 JOIN items b ON b.id = p.id2
    JOIN evidence e ON e.id1 = p.id1 AND e.id2 = p.id2)""",
    f"predicted AS (SELECT *, {_LOGIT_SQL} AS score FROM diagnosed)",
)


@query(
    views.with_views(
        ["human_pairs"],
        *_PREDICTED_SQL,
        query=f"SELECT id1, id2, target, category, {real('score', 'score')} FROM predicted",
    )
)
def score_pairs(spark, sf_dir):
    scored = run_scorer(_human(spark, sf_dir), evidence_scorer())
    return scored.select("id1", "id2", "target", "category", "score")


@query(
    views.with_views(
        ["soft_pairs"],
        ENTRIES_SQL,
        item_texts_sql(fixed.ATTRIBUTE_BUDGET),
        query=f"""SELECT p.id1, p.id2, {real('-4 + 8 * jaccard(lower(a.text), lower(b.text))', 'score')}
        FROM soft_pairs p JOIN texts a ON a.id = p.id1 JOIN texts b ON b.id = p.id2""",
    )
)
def score_pairs_both_ways(spark, sf_dir):
    table = evidence_table(views.soft_pairs(spark, sf_dir), views.items(spark, sf_dir))
    return run_scorer(table, text_scorer(), bidirectional=True).select("id1", "id2", "score")


@query(
    views.with_views(
        ["human_pairs"],
        *_PREDICTED_SQL,
        """limits AS (SELECT category,
        quantile_cont(CAST(surface_similarity AS DOUBLE), 0.75) FILTER (WHERE target <= 0.2)
          AS hard_negative_min_similarity,
        quantile_cont(CAST(surface_similarity AS DOUBLE), 0.25) FILTER (WHERE target >= 0.8)
          AS hard_positive_max_similarity FROM predicted GROUP BY category)""",
        "limited AS (SELECT * FROM predicted JOIN limits USING (category))",
        precision_sql("limited", ["category"], "score", {"all": "true", **STRESS_SQL}),
        query=_CHALLENGE_SQL,
    )
)
def evaluate_matcher(spark, sf_dir):
    """Score, audit and report a labelled table, stress slices included."""
    pairs, items = views.human_pairs(spark, sf_dir), views.items(spark, sf_dir)
    thresholds = summaries.hard_pair_thresholds(_human(spark, sf_dir))
    return evaluation.evaluate(pairs, items, thresholds=settle(thresholds))


def _labelled_teacher(spark, sf_dir):
    return _combined(spark, sf_dir).withColumn(
        "target", (F.col("target") >= F.lit(5.0) / F.lit(9.0)).cast("double")
    )


def _newton_sql(steps: int = 12) -> list[str]:
    """CTEs ``s0 .. s<steps>``: full Newton steps for every category over (logit, label) cells."""
    ctes = ["s0 AS (SELECT category, CAST(0 AS DOUBLE) AS w, CAST(0 AS DOUBLE) AS b FROM fitted)"]
    for k in range(1, steps + 1):
        ctes.append(
            f"""g{k} AS (SELECT category, any_value(w) AS w, any_value(b) AS b,
  any_value(w) + sum(r * x) AS gw, sum(r) AS gb, 1 + sum(c * x * x) AS hww, sum(c * x) AS hwb, sum(c) AS hbb
  FROM (SELECT category, w, b, x, (p + n) * q - p AS r, (p + n) * q * (1 - q) AS c
    FROM (SELECT *, 1 / (1 + exp(-(w * x + b))) AS q FROM s{k - 1} JOIN cells USING (category)))
  GROUP BY category),
s{k} AS (SELECT category, w - (hbb * gw - hwb * gb) / (hww * hbb - hwb * hwb) AS w,
  b - (hww * gb - hwb * gw) / (hww * hbb - hwb * hwb) AS b FROM g{k})"""
        )
    return ctes


@query(
    views.with_views(
        ["teacher"],
        COMBINED_SQL,
        """labelled AS (SELECT category, teacher_logit AS x,
  CASE WHEN target >= CAST(5 AS DOUBLE) / 9 THEN 1 ELSE 0 END AS y FROM combined),
grouped AS (SELECT category, x, y, 10 AS least FROM labelled UNION ALL SELECT 'all', x, y, 1 FROM labelled),
cells AS (SELECT category, x, CAST(count(*) FILTER (y = 1) AS DOUBLE) AS p,
  CAST(count(*) FILTER (y = 0) AS DOUBLE) AS n FROM grouped GROUP BY category, x),
fitted AS (SELECT category FROM grouped GROUP BY category
  HAVING count(*) FILTER (y = 1) >= any_value(least) AND count(*) FILTER (y = 0) >= any_value(least))""",
        *_newton_sql(),
        query=f"SELECT category, {real('w', 'coefficient')}, {real('b', 'intercept')} FROM s12",
    )
)
def platt_fit(spark, sf_dir):
    """Slope and intercept per category and overall."""
    table = settle(_labelled_teacher(spark, sf_dir))
    overall = C.platt_fit(table).select(F.lit("all").alias("category"), "coefficient", "intercept")
    return C.platt_fit(table, ["category"], minimum_class_rows=10).unionByName(overall)


def _training(spark, sf_dir):
    pairs = with_category(views.soft_pairs(spark, sf_dir), views.items(spark, sf_dir))
    return settle(evidence_table(pairs, views.items(spark, sf_dir)).drop("left_text", "right_text"))


@query()
def train_matcher(spark, sf_dir):
    model = learning.train_matcher(_training(spark, sf_dir), confidence_gamma=0.5)
    rows = [("intercept", float(model.intercept))]
    rows += [(n, float(c)) for n, c in zip(learning.FEATURES, model.coefficients, strict=True)]
    return spark.createDataFrame(rows, "feature string, coefficient double")


def _folded(spark, sf_dir):
    """Human evidence with component folds."""
    items = views.items(spark, sf_dir)
    folds = splits.build_folds(views.human_pairs(spark, sf_dir), items).select("id1", "id2", "fold")
    return settle(_human(spark, sf_dir).join(unbroadcast(folds), ["id1", "id2"]))


@query()
def oof_scores(spark, sf_dir):
    """Every human pair scored by a matcher that never saw its component."""
    scored = learning.out_of_fold_scores(_folded(spark, sf_dir), range(5))
    return scored.select("id1", "id2", "target", "category", "fold", "score")


@query()
def model_selection(spark, sf_dir):
    table = _folded(spark, sf_dir)
    grid = [(0.0, 1e-4), (0.0, 1e-2), (1.0, 1e-4)]
    _, report = learning.select_model(table.where("fold <> 0"), table.where("fold = 0"), grid)
    return report


_BLEND = {
    "ECONOMY": (1.0, 0.0), "LARGE": (0.5, 0.5), "MEDIUM": (0.3, 0.7),
    "PROMO": (0.0, 1.0), "SMALL": (0.55, 0.45), "STANDARD": (0.25, 0.75),
}
_POST = {c: (0.9, 0.1) if c in ("PROMO", "SMALL") else (1.0, 0.0) for c in _BLEND}


def _text_model(length: int):
    """A scorer that reads the first ``length`` characters, as a length-limited model does."""
    scorer = text_scorer()

    def score(df):
        cut = df.withColumn("left_text", F.left("left_text", F.lit(length))).withColumn(
            "right_text", F.left("right_text", F.lit(length))
        )
        return scorer(cut)

    return score


_MODELS = (
    ENS.Model("short", _text_model, 40, {"LARGE": 60}),
    ENS.Model("evidence", lambda _: evidence_scorer(), 256),
)
_RESIDUAL = ENS.Residual(ENS.Model("long", _text_model, 80), ("LARGE", "MEDIUM"), 0.75, 0.25)


def _cut_sql(length: str) -> str:
    return f"""CAST(-4 + 8 * jaccard(lower(left(a.text, {length})), lower(left(b.text, {length})))
    AS FLOAT)"""


def _rank_sql(score: str) -> str:
    return f"{average_rank_sql(['category'], score)} / (count(*) OVER (PARTITION BY category) + 1)"


def _case(weights, index: int) -> str:
    cases = " ".join(f"WHEN '{c}' THEN {w[index]}e0" for c, w in weights.items())
    return f"CASE category {cases} END"


@query(
    views.with_views(
        ["human_pairs"],
        *_PREDICTED_SQL,
        item_texts_sql(fixed.ATTRIBUTE_BUDGET),
        f"""modelled AS (SELECT p.id1, p.id2, p.category,
        CASE WHEN p.category IN ('PROMO') THEN CAST(0 AS DOUBLE) ELSE CAST({_cut_sql(
            "CASE WHEN p.category = 'LARGE' THEN 60 ELSE 40 END")} AS DOUBLE) END AS short,
        CASE WHEN p.category = 'ECONOMY' THEN CAST(0 AS DOUBLE)
          ELSE CAST(CAST(p.score AS FLOAT) AS DOUBLE) END AS evidence_score,
        CASE WHEN p.category IN ('LARGE', 'MEDIUM') THEN CAST({_cut_sql('80')} AS DOUBLE)
          ELSE CAST(0 AS DOUBLE) END AS long_score
        FROM predicted p JOIN texts a ON a.id = p.id1 JOIN texts b ON b.id = p.id2)""",
        f"""blended AS (SELECT *, {_case(_BLEND, 0)} * short + {_case(_BLEND, 1)} * evidence_score
        AS reference FROM modelled)""",
        f"""residual AS (SELECT *, CASE WHEN category IN ('LARGE', 'MEDIUM') THEN
        CAST(0.75 AS DOUBLE) * ({_rank_sql('reference')}) + CAST(0.25 AS DOUBLE) * ({_rank_sql('long_score')})
        ELSE reference END AS corrected FROM blended)""",
        query=f"""SELECT id1, id2, {real(f'''{_case(_POST, 0)} * ({_rank_sql('corrected')})
        + {_case(_POST, 1)} * ({_rank_sql('evidence_score')})''', 'predict')} FROM residual""",
    )
)
def ensemble_predict(spark, sf_dir):
    """All stages: length routes, inactive models, category blend, residual, post-blend."""
    whole = ENS.Ensemble(_MODELS, _BLEND, "raw_logit", _RESIDUAL, "evidence", _POST)
    return ENS.predict(views.human_pairs(spark, sf_dir), views.items(spark, sf_dir), whole)


_JOB_VARIANTS_SQL = """variants AS (SELECT id1, id2, l.category, fit, y, teacher_probability AS raw,
  1 / (1 + exp(-greatest(least(a.w * teacher_logit + a.b, 40), -40))) AS global_platt,
  1 / (1 + exp(-greatest(least(coalesce(o.w, a.w) * teacher_logit + coalesce(o.b, a.b), 40), -40))) AS category_platt
  FROM labelled l CROSS JOIN (SELECT w, b FROM s12 WHERE category = 'all') a
  LEFT JOIN (SELECT * FROM s12 WHERE category <> 'all' AND w > 0) o ON o.category = l.category)"""


@query(
    views.with_views(
        ["teacher"],
        COMBINED_SQL,
        """labelled AS (SELECT *, CASE WHEN target >= CAST(5 AS DOUBLE) / 9 THEN 1 ELSE 0 END AS y,
  (id1 * 7 + id2) % 3 <> 0 AS fit FROM combined),
grouped AS (SELECT category, teacher_logit AS x, y, 10 AS least FROM labelled WHERE fit
  UNION ALL SELECT 'all', teacher_logit, y, 1 FROM labelled WHERE fit),
cells AS (SELECT category, x, CAST(count(*) FILTER (y = 1) AS DOUBLE) AS p,
  CAST(count(*) FILTER (y = 0) AS DOUBLE) AS n FROM grouped GROUP BY category, x),
fitted AS (SELECT category FROM grouped GROUP BY category
  HAVING count(*) FILTER (y = 1) >= any_value(least) AND count(*) FILTER (y = 0) >= any_value(least))""",
        *_newton_sql(),
        _JOB_VARIANTS_SQL,
        _CHOICE_SQL.replace("FROM variants)", "FROM variants WHERE NOT fit)"),
        "best AS (SELECT variant FROM choice ORDER BY log_loss, brier, place LIMIT 1)",
        query=f"""SELECT id1, id2, category, (SELECT variant FROM best) AS variant,
        {real('''CAST(CASE (SELECT variant FROM best)
        WHEN 'global_platt' THEN global_platt WHEN 'category_platt' THEN category_platt
        ELSE raw END AS FLOAT)''', 'teacher_probability_calibrated')} FROM variants""",
    )
)
def calibration_job(spark, sf_dir):
    """Two thirds of the pairs fit the slopes, one third picks the variant, all get its probability."""
    rows = _labelled_teacher(spark, sf_dir)
    applied, _ = calibration.calibrate(rows, (F.col("id1") * 7 + F.col("id2")) % 3 != 0)
    return applied.select("id1", "id2", "category", "variant", "teacher_probability_calibrated")


_TEXT_CHUNK = 150
_LENGTHS_SQL = f"""lengths AS (SELECT p.id1, p.id2, length(a.text) + length(b.text) AS size, (row_number() OVER (
  ORDER BY {hash_sql(SEED, 'p.id1', 'p.id2')}, p.id1, p.id2) - 1) // {_TEXT_CHUNK} AS chunk
  FROM soft_pairs p JOIN texts a ON a.id = p.id1 JOIN texts b ON b.id = p.id2)"""


@query(
    views.with_views(
        ["soft_pairs"],
        ENTRIES_SQL,
        item_texts_sql(fixed.ATTRIBUTE_BUDGET),
        _LENGTHS_SQL,
        f"""sorted AS (SELECT id1, id2, chunk, size, row_number() OVER (PARTITION BY chunk
  ORDER BY size, {hash_sql(SEED, 'id1', 'id2')}, id1, id2) - 1 AS place, count(*) OVER (PARTITION BY chunk) AS n
  FROM lengths WHERE (id1 + chunk) % 5 <> 2)""",
        "earlier AS (SELECT chunk, sum(count(*)) OVER (ORDER BY chunk) - count(*) AS b FROM sorted GROUP BY chunk)",
        f"""gaps AS (SELECT s.*, b, least(({BATCH} - b % {BATCH}) % {BATCH}, n) AS needed FROM sorted s JOIN earlier USING (chunk))""",
        """places AS (SELECT *, CAST(b + CASE WHEN place >= n - needed THEN place - (n - needed) ELSE place + needed END AS BIGINT) AS position
  FROM gaps)""",
        query=f"""SELECT id1, id2, CAST(size AS BIGINT) AS size, position // {BATCH} AS batch_id, position % {BATCH} AS batch_row,
        {hash_sql(SEED, f'position // {BATCH}')} AS batch_order FROM places""",
    )
)
def text_batches(spark, sf_dir):
    """Batches of 64 by the length of both evidence texts, over chunks that a filter left of unequal size."""
    rows = evidence_table(views.soft_pairs(spark, sf_dir), views.items(spark, sf_dir))
    sized = publish(rows.select("id1", "id2", (F.length("left_text") + F.length("right_text")).alias("size")))
    chunks = batches.read_chunks(sized, _TEXT_CHUNK, SEED).where((F.col("id1") + F.col("chunk")) % 5 != 2)
    return batches.carried_batches(publish(chunks), BATCH, F.col("size"), SEED).drop("chunk")
