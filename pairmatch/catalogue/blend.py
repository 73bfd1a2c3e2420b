"""Blends, weight search, routers and promotion reports over the scored view."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from pairmatch.catalogue.registry import (
    STRESS_SQL,
    THRESHOLDS_SQL,
    average_rank_sql,
    precision_sql,
    query,
    real,
    spearman_sql,
)
from pairmatch.operators import blending as B
from pairmatch.operators import metrics, summaries
from pairmatch.operators import routing as R
from pairmatch.plans import search
from pairmatch.session import publish, settle
from pairmatch.sources import views

FOLDS = (0, 1, 2, 3, 4)
MODELS = ("score_a", "score_b", "score_c")
WEIGHTS = (0.5, 0.3, 0.2)
BY_CATEGORY = {
    "AF": (0.55, 0.45, 0.0), "AO": (1.0, 0.0, 0.0), "NF": (0.25, 0.25, 0.5),
    "NO": (0.0, 0.6, 0.4), "RF": (0.4, 0.4, 0.2), "RO": (0.1, 0.9, 0.0),
}
GATES = R.Gates(minimum_uplift=0.002, positive_folds=4, nonnegative_categories=5)
THREE_STEP, TWO_STEP, SEARCH_STEP = 0.1, 0.05, 0.2


def oof(spark, sf_dir, *columns):
    """The scored view, or the columns named, as a published out-of-fold table: every plan
    below rereads it."""
    scored = views.scored(spark, sf_dir)
    return publish(scored.select(*columns) if columns else scored)


GRID_FIELDS = ("category", "fold", "target", *MODELS)


def _weight_table(spark):
    rows = [(c, list(w)) for c, w in BY_CATEGORY.items()]
    return spark.createDataFrame(rows, "category string, weights array<double>")


def _case(index: int) -> str:
    cases = " ".join(f"WHEN '{c}' THEN {w[index]}e0" for c, w in BY_CATEGORY.items())
    return f"CASE category {cases} END"


def _rank(score: str, *keys: str) -> str:
    group = list(keys) or ["category"]
    return (
        f"({average_rank_sql(group, score)}"
        f" / (count(*) OVER (PARTITION BY {', '.join(group)}) + 1))"
    )


def _sum(weights, columns) -> str:
    return " + ".join(f"{w}e0 * {c}" for w, c in zip(weights, columns, strict=True))


@query(
    views.with_views(
        ["scored"],
        query=f"SELECT id1, id2, {real(_sum(WEIGHTS, MODELS), 'predict')} FROM scored",
    )
)
def blend_global(spark, sf_dir):
    blended = B.blend_scores(views.scored(spark, sf_dir), MODELS, WEIGHTS)
    return blended.select("id1", "id2", "predict")


@query(
    views.with_views(
        ["scored"],
        query=f"""SELECT id1, id2,
        {real(' + '.join(f'{_case(i)} * {m}' for i, m in enumerate(MODELS)), 'predict')} FROM scored""",
    )
)
def blend_category(spark, sf_dir):
    blended = B.blend_scores(views.scored(spark, sf_dir), MODELS, _weight_table(spark))
    return blended.select("id1", "id2", "predict")


@query(
    views.with_views(
        ["scored"],
        query=f"""SELECT id1, id2,
        {real(' + '.join(f'{_case(i)} * {_rank(m)}' for i, m in enumerate(MODELS)), 'predict')}
        FROM scored""",
    )
)
def blend_category_rank(spark, sf_dir):
    blended = B.blend_scores(
        views.scored(spark, sf_dir), MODELS, _weight_table(spark), "category_rank"
    )
    return blended.select("id1", "id2", "predict")


@query(
    views.with_views(
        ["scored"],
        query="SELECT category, count(*) AS rows FROM scored WHERE "
        + f"{_case(2)} > 0 GROUP BY category",
    )
)
def active_models(spark, sf_dir):
    active = B.active_rows(views.scored(spark, sf_dir), _weight_table(spark), 2)
    return summaries.category_counts(active)


@query(
    views.with_views(
        ["scored"],
        query=f"""SELECT CASE category WHEN 'AF' THEN 384 WHEN 'NO' THEN 512 ELSE 256 END AS max_length,
        count(*) AS rows FROM scored WHERE {_case(0)} > 0 GROUP BY 1""",
    )
)
def length_routes(spark, sf_dir):
    active = B.active_rows(views.scored(spark, sf_dir), _weight_table(spark), 0)
    routes = spark.createDataFrame([("AF", 384), ("NO", 512)], "category string, max_length int")
    routed = B.with_length_route(active, routes, 256)
    return routed.groupBy("max_length").agg(F.count(F.lit(1)).alias("rows"))


_RESIDUAL_SQL = f"""CASE WHEN category IN ('AF', 'RO')
  THEN CAST(0.75 AS DOUBLE) * {_rank('score_a')} + CAST(0.25 AS DOUBLE) * {_rank('score_b')}
  ELSE score_a END"""


@query(
    views.with_views(
        ["scored"], query=f"SELECT id1, id2, {real(_RESIDUAL_SQL, 'predict')} FROM scored"
    )
)
def residual_blend(spark, sf_dir):
    mixed = B.rank_residual(
        views.scored(spark, sf_dir), "score_a", "score_b", ["AF", "RO"], 0.75, 0.25
    )
    return mixed.select("id1", "id2", "predict")


@query(
    views.with_views(
        ["scored"],
        f"first AS (SELECT *, {_RESIDUAL_SQL} AS prediction FROM scored)",
        query=f"""SELECT id1, id2, {real(f"0.9e0 * {_rank('prediction')} + 0.1e0 * {_rank('score_c')}",
        'predict')} FROM first""",
    )
)
def post_blend(spark, sf_dir):
    mixed = B.rank_residual(
        views.scored(spark, sf_dir), "score_a", "score_b", ["AF", "RO"], 0.75, 0.25
    )
    late = B.blend_scores(
        settle(mixed.withColumnRenamed("predict", "prediction")),
        ["prediction", "score_c"],
        (0.9, 0.1),
        "category_rank",
    )
    return late.select("id1", "id2", "predict")


# -- weight search -----------------------------------------------------------------------


def candidates_sql(models: int, step: float) -> str:
    rows = ", ".join(
        f"({i}, " + ", ".join(f"{w}e0" for w in v) + ")" for i, v in enumerate(B.simplex(models, step))
    )
    names = ", ".join(["candidate", *[f"w{i}" for i in range(models)]])
    return f"cand({names}) AS (VALUES {rows})"


_COHORTS = {"all": "true"} | {f"except_{f}": f"fold <> {f}" for f in FOLDS}


def _dot(count: int) -> str:
    return " + ".join(f"w{i} * f{i}" for i in range(count))


def grid_sql(models, step: float, source: str = "longf", keys=()) -> tuple[str, ...]:
    """CTEs up to ``grid(keys, category, candidate, cohort, ..., average_precision)``."""
    chosen = ", ".join([*keys, "category", "fold", "target", "candidate"])
    return (
        candidates_sql(len(models), step),
        f"spread AS (SELECT {chosen}, {_dot(len(models))} AS blend FROM {source}, cand)",
        precision_sql("spread", [*keys, "category", "candidate"], "blend", _COHORTS, out="grid"),
    )


def _plain_sql(models) -> str:
    columns = ", ".join(f"{m} AS f{i}" for i, m in enumerate(models))
    return f"longf AS (SELECT id1, id2, category, fold, target, {columns} FROM scored)"


PICK = """list_reduce(list({'c': candidate, 's': s, 'n': n} ORDER BY candidate),
  lambda a, x: CASE WHEN x.s > a.s + 1e-12 THEN x
  WHEN abs(x.s - a.s) <= 1e-12 + 1e-5 * abs(a.s) THEN {'c': x.c, 's': a.s, 'n': x.n} ELSE a END)"""
_CELLS_SQL = "cells AS (SELECT cohort, category, candidate, average_precision AS s, rows AS n FROM grid)"
_MACRO_SQL = """cells AS (SELECT cohort, candidate, avg(average_precision) AS s,
  CAST(sum(rows) AS BIGINT) AS n FROM grid GROUP BY ALL)"""


def _grid(spark, sf_dir, models=MODELS, step=THREE_STEP):
    candidates = B.simplex(len(models), step)
    return B.weight_grid(oof(spark, sf_dir, *GRID_FIELDS), models, candidates, FOLDS), candidates


@query(
    views.with_views(
        ["scored"],
        _plain_sql(MODELS),
        *grid_sql(MODELS, THREE_STEP),
        query=f"""SELECT category, CAST(candidate AS BIGINT) AS candidate, cohort, rows, positives,
        {real('average_precision', 'average_precision')} FROM grid""",
    )
)
def weight_grid(spark, sf_dir):
    return _grid(spark, sf_dir)[0]


def _weights_text():
    return F.array_join(F.transform("weights", lambda w: F.round(w * 100).cast("int").cast("string")), "/")


def _weights_sql(count: int) -> str:
    return " || '/' || ".join(f"CAST(CAST(round(w{i} * 100) AS INT) AS VARCHAR)" for i in range(count))


@query(
    views.with_views(
        ["scored"],
        _plain_sql(MODELS),
        *grid_sql(MODELS, THREE_STEP),
        _MACRO_SQL,
        f"best AS (SELECT cohort, {PICK} AS b FROM cells GROUP BY cohort)",
        query=f"""SELECT cohort, {_weights_sql(3)} AS weights, {real('b.s', 'training_score')},
        b.n AS training_rows FROM best JOIN cand ON candidate = b.c""",
    )
)
def best_weights(spark, sf_dir):
    grid, candidates = _grid(spark, sf_dir)
    best = B.best_candidates(B.macro_grid(grid), ["cohort"], candidates)
    return best.withColumn("weights", _weights_text())


@query(
    views.with_views(
        ["scored"],
        _plain_sql(MODELS),
        *grid_sql(MODELS, THREE_STEP),
        _CELLS_SQL,
        f"best AS (SELECT category, {PICK} AS b FROM cells WHERE cohort = 'all' GROUP BY category)",
        query=f"""SELECT category, {_weights_sql(3)} AS weights, {real('b.s', 'training_score')},
        b.n AS training_rows FROM best JOIN cand ON candidate = b.c""",
    )
)
def final_weights(spark, sf_dir):
    grid, candidates = _grid(spark, sf_dir)
    return B.final_weights(grid, candidates, "category").withColumn("weights", _weights_text())


def _crossed(spark, sf_dir, models, step, scope):
    scored = oof(spark, sf_dir, "id1", "id2", *GRID_FIELDS)
    candidates = B.simplex(len(models), step)
    grid = B.weight_grid(scored, models, candidates, FOLDS)
    weights = settle(B.cross_fitted_weights(grid, candidates, scope))
    return B.cross_fitted_predictions(scored, models, weights).select(
        "id1", "id2", "fold", "category", "predict"
    )


_TWO = ("score_a", "score_b")


@query(
    views.with_views(
        ["scored"],
        _plain_sql(_TWO),
        *grid_sql(_TWO, TWO_STEP),
        _MACRO_SQL,
        f"best AS (SELECT cohort, {PICK} AS b FROM cells GROUP BY cohort)",
        query=f"""SELECT id1, id2, fold, category, {real(_dot(2), 'predict')} FROM longf
        JOIN best ON cohort = 'except_' || fold JOIN cand ON candidate = b.c""",
    )
)
def cross_fitted_global(spark, sf_dir):
    return _crossed(spark, sf_dir, _TWO, TWO_STEP, "global")


@query(
    views.with_views(
        ["scored"],
        _plain_sql(_TWO),
        *grid_sql(_TWO, TWO_STEP),
        _CELLS_SQL,
        f"best AS (SELECT cohort, category, {PICK} AS b FROM cells GROUP BY cohort, category)",
        query=f"""SELECT id1, id2, fold, l.category, {real(_dot(2), 'predict')} FROM longf l
        JOIN best t ON cohort = 'except_' || fold AND t.category = l.category
        JOIN cand ON candidate = b.c""",
    )
)
def cross_fitted_category(spark, sf_dir):
    return _crossed(spark, sf_dir, _TWO, TWO_STEP, "category")


# -- reports -------------------------------------------------------------------------------

REPORT_SQL = {"all": "true"} | {f"fold_{f}": f"fold = {f}" for f in FOLDS} | STRESS_SQL


def gates_sql(report: str, minimum_uplift: float = 0.002, extra: str = "true") -> str:
    """CTEs from ``report(variant, category, cohort, average_precision)`` to ``verdicts``."""
    return f"""compared AS (SELECT c.variant, c.category, c.cohort, c.average_precision AS candidate,
  b.average_precision AS reference, round(c.average_precision - b.average_precision, 12) AS delta
  FROM {report} c JOIN {report} b USING (category, cohort)
  WHERE b.variant = 'base' AND c.variant <> 'base'),
means AS (SELECT variant, cohort, avg(candidate) AS candidate, round(avg(candidate) - avg(reference), 12) AS delta
  FROM compared GROUP BY ALL),
overall AS (SELECT variant, max(candidate) FILTER (WHERE cohort = 'all') AS score,
  max(delta) FILTER (WHERE cohort = 'all') AS uplift,
  count(*) FILTER (WHERE cohort LIKE 'fold_%' AND delta > 0) AS positive_folds,
  min(delta) FILTER (WHERE cohort NOT LIKE 'fold_%' AND cohort <> 'all') AS worst_stress_delta
  FROM means GROUP BY variant),
per_category AS (SELECT variant, count(*) FILTER (WHERE delta >= 0) AS nonnegative_categories,
  count(*) FILTER (WHERE delta > 0) AS positive_categories, min(delta) AS worst_category_delta
  FROM compared WHERE cohort = 'all' GROUP BY variant),
verdicts AS (SELECT *, uplift >= {minimum_uplift} AND positive_folds >= 4 AND nonnegative_categories >= 5
  AND worst_category_delta >= -0.005 AND worst_stress_delta >= 0 AND {extra} AS passed
  FROM overall JOIN per_category USING (variant))"""


VERDICT_COLUMNS = f"""variant, {real('score', 'score')}, {real('uplift', 'uplift')}, positive_folds,
  {real('worst_stress_delta', 'worst_stress_delta')}, nonnegative_categories, positive_categories,
  {real('worst_category_delta', 'worst_category_delta')}, passed"""


def _ranked_sql(models) -> str:
    ranks = ", ".join(f"{_rank(m, 'category', 'fold')} AS r{i}" for i, m in enumerate(models))
    kept = "id1, id2, category, fold, target, surface_similarity, identity_conflicts"
    limits = "hard_negative_min_similarity, hard_positive_max_similarity"
    raw = ", ".join(f"{m} AS f{i}" for i, m in enumerate(models))
    rank = ", ".join(f"r{i} AS f{i}" for i in range(len(models)))
    return f"""ranked AS (SELECT *, {ranks} FROM stressed),
longf AS (SELECT {kept}, {limits}, 'raw_logit' AS representation, {raw} FROM ranked
  UNION ALL SELECT {kept}, {limits}, 'category_rank', {rank} FROM ranked)"""


def _methods_sql(models, sizes, scopes) -> tuple[str, ...]:
    """CTEs to ``predicted``: every method's cross-fitted prediction per row."""
    parts = []
    for size in sizes:
        for used in combinations(range(len(models)), size):
            label = "+".join(models[i] for i in used)
            zero = " AND ".join(f"w{i} = 0" for i in range(len(models)) if i not in used) or "true"
            for scope in scopes:
                keys = "representation, cohort" + (", category" if scope == "category" else "")
                cells = "cat_cells" if scope == "category" else "mac_cells"
                category = "category" if scope == "category" else "CAST(NULL AS VARCHAR)"
                parts.append(
                    f"""SELECT '{label}__' || representation || '__{scope}' AS variant,
  representation, cohort, {category} AS category, {PICK} AS b
  FROM {cells} JOIN cand USING (candidate) WHERE {zero} GROUP BY {keys}"""
                )
    picked = "\nUNION ALL\n".join(parts)
    return (
        """cat_cells AS (SELECT representation, cohort, category, candidate,
  average_precision AS s, rows AS n FROM grid)""",
        """mac_cells AS (SELECT representation, cohort, candidate, avg(average_precision) AS s,
  CAST(sum(rows) AS BIGINT) AS n FROM grid GROUP BY ALL)""",
        f"picked AS ({picked})",
        f"""predicted AS (SELECT p.variant, l.category, fold, target, surface_similarity,
  identity_conflicts, hard_negative_min_similarity, hard_positive_max_similarity,
  {_dot(len(models))} AS predict FROM longf l JOIN picked p ON p.representation = l.representation
  AND p.cohort = 'except_' || l.fold AND (p.category IS NULL OR p.category = l.category)
  JOIN cand ON cand.candidate = p.b.c
  UNION ALL SELECT 'base', category, fold, target, surface_similarity, identity_conflicts,
  hard_negative_min_similarity, hard_positive_max_similarity, {models[0]} FROM stressed)""",
        precision_sql("predicted", ["variant", "category"], "predict", REPORT_SQL, out="report"),
    )


_SEARCH_SQL = (
    THRESHOLDS_SQL,
    _ranked_sql(MODELS),
    *grid_sql(MODELS, SEARCH_STEP, keys=["representation"]),
    *_methods_sql(MODELS, (2, 3), ("global", "category")),
    gates_sql("report"),
)


def _search(spark, sf_dir):
    scored = oof(spark, sf_dir)
    thresholds = settle(summaries.hard_pair_thresholds(scored))
    return search.ensemble_search(scored, thresholds, MODELS, FOLDS, SEARCH_STEP, GATES)


@query(views.with_views(["scored"], *_SEARCH_SQL, query=f"SELECT {VERDICT_COLUMNS} FROM verdicts"))
def ensemble_search(spark, sf_dir):
    """Sixteen methods: subsets of two and three models, raw or rank, global or category."""
    return _search(spark, sf_dir)


_TWO_SQL = (
    THRESHOLDS_SQL,
    _ranked_sql(_TWO),
    *grid_sql(_TWO, TWO_STEP, keys=["representation"]),
    *_methods_sql(_TWO, (2,), ("global",)),
    """weighed AS (SELECT variant,
  max(w1) FILTER (WHERE cohort <> 'all') - min(w1) FILTER (WHERE cohort <> 'all') AS weight_range,
  max(w1) FILTER (WHERE cohort = 'all') AS final_weight
  FROM picked JOIN cand ON candidate = b.c GROUP BY variant)""",
    gates_sql("report").replace(
        "FROM overall JOIN per_category USING (variant))",
        "FROM overall JOIN per_category USING (variant) JOIN weighed USING (variant))",
    ).replace("AND true AS passed", "AND weight_range <= 0.25 AND final_weight > 0 AS passed"),
)


def _two(spark, sf_dir):
    scored = oof(spark, sf_dir)
    thresholds = settle(summaries.hard_pair_thresholds(scored))
    gates = R.Gates(0.002, 4, 5, -0.005, 0.0, 0.25)
    return search.two_model_report(
        scored, thresholds, *_TWO, FOLDS, TWO_STEP, gates, correction=0.279, margin=0.02
    )


@query(
    views.with_views(
        ["scored"],
        *_TWO_SQL,
        query=f"""SELECT {VERDICT_COLUMNS}, {real('weight_range', 'weight_range')},
        {real('final_weight', 'final_weight')}, {real('score - 0.279', 'forecast')},
        {real('score - 0.279 - 0.02', 'forecast_low')},
        {real('score - 0.279 + 0.02', 'forecast_high')} FROM verdicts""",
    )
)
def two_model_report(spark, sf_dir):
    return _two(spark, sf_dir)


@query(
    views.with_views(
        ["scored"],
        *_TWO_SQL,
        query=f"""SELECT variant, {real('score', 'score')}, passed,
        row_number() OVER (ORDER BY score DESC, variant) AS position,
        coalesce(variant = (SELECT arg_max(variant, score) FROM verdicts WHERE passed), false)
          AS winner FROM verdicts""",
    )
)
def method_ranking(spark, sf_dir):
    return R.ranking(settle(_two(spark, sf_dir)))


_DEPLOY_STEP = 0.25


@query(
    views.with_views(
        ["scored"],
        THRESHOLDS_SQL,
        _ranked_sql(MODELS),
        *grid_sql(MODELS, _DEPLOY_STEP, keys=["representation"]),
        *_methods_sql(MODELS, (3,), ("global", "category"))[:3],
        query=f"""SELECT variant, {real('avg(w0 * 0.25e0 + w1 * 0.26e0 + w2 * 0.28e0)', 'correction')}
        FROM picked JOIN cand ON candidate = b.c WHERE cohort = 'all' GROUP BY variant""",
    )
)
def forecast_corrections(spark, sf_dir):
    long = publish(search.long_features(oof(spark, sf_dir, "id1", "id2", *GRID_FIELDS), MODELS))
    _, final = search.search_weights(long, MODELS, FOLDS, _DEPLOY_STEP, (3,))
    gaps = {"score_a": 0.25, "score_b": 0.26, "score_c": 0.28}
    return search.weighted_corrections(final, MODELS, gaps)


# -- routers ---------------------------------------------------------------------------------

_MIX = "0.55e0 * score_a + 0.45e0 * score_b"
_TRAIN_COHORTS = (
    {"all": "true"}
    | {f"fold_{f}": f"fold = {f}" for f in FOLDS}
    | {f"except_{f}": f"fold <> {f}" for f in FOLDS}
)


def deltas_sql(base: str, candidate: str) -> tuple[str, ...]:
    """CTEs to ``deltas(category, validation_fold, delta, positive_folds)``."""
    return (
        f"""arms AS (SELECT 'base' AS variant, category, fold, target, {base} AS s0 FROM scored
  UNION ALL SELECT 'candidate', category, fold, target, {candidate} FROM scored)""",
        precision_sql("arms", ["variant", "category"], "s0", _TRAIN_COHORTS, out="arm"),
        """uplift AS (SELECT c.category, c.cohort, round(c.average_precision - b.average_precision, 12) AS delta
  FROM arm c JOIN arm b USING (category, cohort) WHERE c.variant = 'candidate' AND b.variant = 'base')""",
        """deltas AS (SELECT u.category, CASE WHEN u.cohort = 'all' THEN NULL
  ELSE CAST(substr(u.cohort, 8) AS INT) END AS validation_fold, u.delta,
  (SELECT count(*) FROM uplift f WHERE f.category = u.category AND f.cohort LIKE 'fold_%'
   AND f.delta > 0 AND f.cohort <> replace(u.cohort, 'except', 'fold')) AS positive_folds
  FROM uplift u WHERE u.cohort = 'all' OR u.cohort LIKE 'except_%')""",
    )


@query(
    views.with_views(
        ["scored"],
        *deltas_sql("score_a", _MIX),
        query=f"""SELECT category, validation_fold, {real('delta', 'delta')}, positive_folds,
        row_number() OVER (PARTITION BY validation_fold ORDER BY delta DESC, category) AS position
        FROM deltas""",
    )
)
def category_uplift(spark, sf_dir):
    """Categories ranked by uplift for every training cohort."""
    mix = F.lit(0.55) * F.col("score_a") + F.lit(0.45) * F.col("score_b")
    deltas = R.training_deltas(oof(spark, sf_dir), FOLDS, F.col("score_a"), mix)
    return R.top_categories(deltas)


@query(
    views.with_views(
        ["scored"],
        THRESHOLDS_SQL,
        *deltas_sql("score_a", _MIX),
        """routes AS (SELECT category, validation_fold AS fold, row_number() OVER (
  PARTITION BY validation_fold ORDER BY delta DESC, category) AS position
  FROM deltas WHERE validation_fold IS NOT NULL)""",
        f"""routed AS (SELECT 'top_' || lpad(CAST(k AS VARCHAR), 2, '0') AS variant, category, fold, target,
  surface_similarity, identity_conflicts, hard_negative_min_similarity, hard_positive_max_similarity,
  CASE WHEN position <= k THEN {_MIX} ELSE score_a END AS predict
  FROM stressed JOIN routes USING (category, fold), (SELECT unnest(range(1, 7)) AS k) ks
  UNION ALL SELECT 'base', category, fold, target, surface_similarity, identity_conflicts,
  hard_negative_min_similarity, hard_positive_max_similarity, score_a FROM stressed)""",
        precision_sql("routed", ["variant", "category"], "predict", REPORT_SQL, out="report"),
        gates_sql("report"),
        query=f"SELECT {VERDICT_COLUMNS} FROM verdicts",
    )
)
def topk_router(spark, sf_dir):
    scored = oof(spark, sf_dir)
    thresholds = settle(summaries.hard_pair_thresholds(scored))
    mix = F.lit(0.55) * F.col("score_a") + F.lit(0.45) * F.col("score_b")
    return search.router_report(scored, thresholds, FOLDS, "score_a", mix, GATES)


_ROUTE_SQL = (
    *deltas_sql("score_b", "score_a"),
    """route AS (SELECT validation_fold, category FROM deltas WHERE delta >= 0.03
  AND positive_folds >= CASE WHEN validation_fold IS NULL THEN 4 ELSE 3 END)""",
    """routed AS (SELECT s.*, r.category IS NOT NULL AS routed,
  CASE WHEN r.category IS NOT NULL THEN score_a ELSE score_b END AS predict
  FROM stressed s LEFT JOIN route r ON r.category = s.category AND r.validation_fold = s.fold)""",
)


def _route(spark, sf_dir):
    deltas = R.training_deltas(
        oof(spark, sf_dir), FOLDS, F.col("score_b"), F.col("score_a")
    )
    return R.select_route(deltas, 0.03)


@query(
    views.with_views(
        ["scored"],
        THRESHOLDS_SQL,
        *_ROUTE_SQL,
        query="SELECT category, validation_fold FROM route",
    )
)
def route_selection(spark, sf_dir):
    return _route(spark, sf_dir)


@query(
    views.with_views(
        ["scored"],
        THRESHOLDS_SQL,
        *_ROUTE_SQL,
        """both_arms AS (SELECT 'routed' AS variant, category, fold, target, surface_similarity,
  identity_conflicts, hard_negative_min_similarity, hard_positive_max_similarity, predict FROM routed
  UNION ALL SELECT 'base', category, fold, target, surface_similarity, identity_conflicts,
  hard_negative_min_similarity, hard_positive_max_similarity, score_b FROM routed)""",
        precision_sql("both_arms", ["variant", "category"], "predict", REPORT_SQL, out="report"),
        gates_sql("report"),
        query=f"SELECT {VERDICT_COLUMNS} FROM verdicts",
    )
)
def category_route(spark, sf_dir):
    """Cross-fitted route, applied and judged."""
    scored = oof(spark, sf_dir)
    thresholds = settle(summaries.hard_pair_thresholds(scored))
    _, _, verdict = search.category_route_report(
        scored, thresholds, FOLDS, "score_b", "score_a", 0.03, GATES
    )
    return verdict


_RECORDED = [(f, c) for f in FOLDS for i, c in enumerate(BY_CATEGORY) if (f + i) % 2 == 0]
_RECORDED_SQL = "recorded(fold, category) AS (VALUES " + ", ".join(
    f"({f}, '{c}')" for f, c in _RECORDED
) + ")"
_REBUILT_SQL = f"""rebuilt AS (SELECT s.*, r.hit IS NOT NULL AS routed,
  CASE WHEN r.hit IS NULL THEN score_a ELSE {_MIX} END AS predict
  FROM scored s LEFT JOIN (SELECT *, 1 AS hit FROM recorded) r USING (fold, category))"""


def _rebuilt(spark, sf_dir):
    recorded = spark.createDataFrame(_RECORDED, "validation_fold int, category string")
    mix = F.lit(0.55) * F.col("score_a") + F.lit(0.45) * F.col("score_b")
    return R.apply_route(views.scored(spark, sf_dir), recorded, F.col("score_a"), mix)


@query(
    views.with_views(
        ["scored"],
        _RECORDED_SQL,
        _REBUILT_SQL,
        precision_sql("rebuilt", ["category"], "predict", {"all": "true"}),
        query=f"""SELECT {real('avg(average_precision)', 'macro_average_precision')},
        true AS matches_record FROM ap""",
    )
)
def rebuild_route(spark, sf_dir):
    """Scores rebuilt from recorded selections reproduce the recorded metric."""
    rebuilt = _rebuilt(spark, sf_dir)
    recorded = metrics.macro(metrics.average_precision(rebuilt, ["category"], "predict"))
    again = R.variant_report(rebuilt, {"v": F.col("predict")}, {"all": F.lit(True)})
    check = again.agg(F.avg("average_precision").alias("m"))
    return recorded.select(
        "macro_average_precision",
        (F.abs(F.col("macro_average_precision") - check.scalar()) <= 1e-12).alias("matches_record"),
    )


@query(
    views.with_views(
        ["scored"],
        _RECORDED_SQL,
        _REBUILT_SQL,
        query=f"SELECT id1, id2, routed, {real('predict', 'predict')} FROM rebuilt",
    )
)
def routed_scores(spark, sf_dir):
    return _rebuilt(spark, sf_dir).select("id1", "id2", "routed", "predict")


_FOLD_RESIDUAL_SQL = f"""CASE WHEN category IN ('AF', 'RO') THEN
  CAST(0.75 AS DOUBLE) * {_rank('score_a', 'category', 'fold')}
  + CAST(0.25 AS DOUBLE) * {_rank('score_b', 'category', 'fold')} ELSE score_a END"""


@query(
    views.with_views(
        ["scored"],
        THRESHOLDS_SQL,
        f"""arms2 AS (SELECT 'residual' AS variant, category, fold, target, surface_similarity,
  identity_conflicts, hard_negative_min_similarity, hard_positive_max_similarity,
  {_FOLD_RESIDUAL_SQL} AS predict FROM stressed
  UNION ALL SELECT 'base', category, fold, target, surface_similarity, identity_conflicts,
  hard_negative_min_similarity, hard_positive_max_similarity, score_a FROM stressed)""",
        precision_sql("arms2", ["variant", "category"], "predict", REPORT_SQL, out="report"),
        gates_sql("report", 0.0),
        query=f"SELECT {VERDICT_COLUMNS} FROM verdicts".replace(
            "passed", "uplift >= 0 AND positive_folds >= 4 AND worst_stress_delta >= 0 AS passed"
        ),
    )
)
def oof_residual(spark, sf_dir):
    scored = oof(spark, sf_dir)
    thresholds = settle(summaries.hard_pair_thresholds(scored))
    return search.residual_report(
        scored, thresholds, FOLDS, "score_a", "score_b", ["AF", "RO"], 0.75, 0.25
    )


_ARM_COHORTS = {"all_folds": "true", "folds_1_4": "fold <> 0"} | {
    f"fold_{f}": f"fold = {f}" for f in FOLDS
}


@query(
    views.with_views(
        ["scored"],
        """arms AS (SELECT 'first' AS variant, category, fold, target, score_a AS s0 FROM scored
  UNION ALL SELECT 'second', category, fold, target, score_b FROM scored)""",
        precision_sql("arms", ["variant", "category"], "s0", _ARM_COHORTS, out="arm"),
        query=f"""SELECT category, cohort, {real('f.average_precision', 'first')},
        {real('s.average_precision', 'second')},
        {real('s.average_precision - f.average_precision', 'delta')}
        FROM arm f JOIN arm s USING (category, cohort)
        WHERE f.variant = 'first' AND s.variant = 'second'""",
    )
)
def paired_arms(spark, sf_dir):
    cohorts = {"all_folds": F.lit(True), "folds_1_4": F.col("fold") != 0}
    cohorts |= {f"fold_{f}": F.col("fold") == f for f in FOLDS}
    report = R.variant_report(
        views.scored(spark, sf_dir),
        {"first": F.col("score_a"), "second": F.col("score_b")},
        cohorts,
    )
    return R.paired_arms(report, ["first", "second"])


_SHIPPED_SQL = f"""shipped AS (SELECT *, {_sum(WEIGHTS, MODELS)} AS expected,
  CAST({_sum(WEIGHTS, MODELS)} AS FLOAT) AS f, 1 AS one FROM scored),
actuals AS (SELECT *, CAST(f AS DOUBLE) AS actual FROM shipped)"""


@query(
    views.with_views(
        ["scored"],
        _SHIPPED_SQL,
        spearman_sql("actuals", ["one"], "actual", "expected", "sp"),
        spearman_sql("actuals", ["category"], "actual", "expected", "sc"),
        query=f"""SELECT count(*) AS rows, {real('max(abs(actual - expected))', 'max_abs_delta')},
        {real('avg(abs(actual - expected))', 'mean_abs_delta')},
        (SELECT round(spearman, 9) FROM sp) AS global_spearman,
        (SELECT round(min(spearman), 9) FROM sc) AS minimum_category_spearman, true AS passed
        FROM actuals""",
    )
)
def parity_check(spark, sf_dir):
    """Scores shipped in single precision against the recomputed blend."""
    blended = B.blend_scores(views.scored(spark, sf_dir), MODELS, WEIGHTS, out="expected")
    shipped = blended.withColumn("actual", F.col("expected").cast("float").cast("double"))
    return R.parity(settle(shipped), "actual", "expected")
