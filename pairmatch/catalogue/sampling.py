"""Quotas, candidate pools, priorities, replay and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairmatch.catalogue.quality import _SIMILARITY_SQL
from pairmatch.catalogue.registry import (
    THRESHOLDS_SQL,
    average_rank_sql,
    hash_sql,
    query,
    real,
)
from pairmatch.operators import batches, joins, mining, splits, summaries
from pairmatch.operators.calibration import combine_directions
from pairmatch.session import settle
from pairmatch.sources import views

SEED = 2026
WEAK = ("PROMO", "SMALL")
QUOTA_ROWS, WEAK_FRACTION = 301, 0.45
_WEAK_ROWS = round(QUOTA_ROWS * WEAK_FRACTION)

QUOTA_SQL = f"""classes AS (SELECT category, category IN ('PROMO', 'SMALL') AS weak
  FROM (SELECT DISTINCT category FROM items)),
quotas AS (SELECT category, CAST(share // size + CASE WHEN pos < share % size THEN 1 ELSE 0 END
  AS BIGINT) AS quota FROM (SELECT category,
    CASE WHEN weak THEN {_WEAK_ROWS} ELSE {QUOTA_ROWS - _WEAK_ROWS} END AS share,
    count(*) OVER (PARTITION BY weak) AS size,
    row_number() OVER (PARTITION BY weak ORDER BY category) - 1 AS pos FROM classes))"""


def quotas(spark, sf_dir):
    return mining.category_quotas(views.items(spark, sf_dir), WEAK, QUOTA_ROWS, WEAK_FRACTION)


@query(views.with_views(["items"], QUOTA_SQL, query="SELECT * FROM quotas"))
def category_quotas(spark, sf_dir):
    return quotas(spark, sf_dir)


def _soft_joined(spark, sf_dir):
    joined = joins.pair_join(views.soft_pairs(spark, sf_dir), views.items(spark, sf_dir), ["name"])
    return joins.with_surface_similarity(joined)


_POOL_SQL = (
    QUOTA_SQL,
    """named AS (SELECT p.id1, p.id2, p.target, a.category, lower(coalesce(a.name, '')) AS ln,
  lower(coalesce(b.name, '')) AS rn
  FROM soft_pairs p JOIN items a ON a.id = p.id1 JOIN items b ON b.id = p.id2)""",
    f"""labelled AS (SELECT id1, id2, target, category, {_SIMILARITY_SQL} AS surface_similarity,
  CASE WHEN target <= CAST(2 AS DOUBLE) / 9 THEN 0 WHEN target >= CAST(7 AS DOUBLE) / 9 THEN 1
  ELSE 2 END AS candidate_stratum FROM named)""",
    f"""in_stratum AS (SELECT *, row_number() OVER (PARTITION BY category, candidate_stratum ORDER BY
  CASE WHEN candidate_stratum = 0 THEN surface_similarity END DESC NULLS LAST,
  CASE WHEN candidate_stratum = 1 THEN surface_similarity END ASC NULLS LAST,
  CASE WHEN candidate_stratum = 2 THEN abs(target - 0.5) END ASC NULLS LAST,
  {hash_sql(SEED, 'id1', 'id2')}, id1, id2) AS stratum_row FROM labelled)""",
    f"""interleaved AS (SELECT s.*, q.quota, row_number() OVER (PARTITION BY category ORDER BY
  stratum_row, candidate_stratum, {hash_sql(SEED + 1, 'id1', 'id2')}, id1, id2) AS category_row
  FROM in_stratum s JOIN quotas q USING (category))""",
    "pool AS (SELECT * FROM interleaved WHERE category_row <= quota)",
)


def _pool(spark, sf_dir):
    # The smallest tables hold fewer rows than the quotas ask for.
    return mining.candidate_pool(
        _soft_joined(spark, sf_dir), quotas(spark, sf_dir), SEED, short="allow"
    )


@query(
    views.with_views(
        ["soft_pairs"],
        *_POOL_SQL,
        query=f"""SELECT id1, id2, category, candidate_stratum, {real('target', 'target')},
        {real('surface_similarity', 'surface_similarity')} FROM pool""",
    )
)
def candidate_pool(spark, sf_dir):
    return _pool(spark, sf_dir).select(
        "id1", "id2", "category", "candidate_stratum", "target", "surface_similarity"
    )


@query(
    views.with_views(
        ["soft_pairs"],
        *_POOL_SQL,
        query=f"""SELECT category, candidate_stratum, count(*) AS rows,
        {real('avg(target)', 'mean_target')} FROM pool GROUP BY ALL""",
    )
)
def candidate_summary(spark, sf_dir):
    return summaries.grouped_means(
        _pool(spark, sf_dir), ["category", "candidate_stratum"], ["target"]
    )


def _ranked_sql(score: str) -> str:
    return f"""({average_rank_sql(['category'], score)} - 1)
  / greatest(count(*) OVER (PARTITION BY category) - 1, 1)"""


_PRIORITY_SQL = (
    f"""ranked AS (SELECT *, {_ranked_sql('teacher_logit_forward')} AS ra,
  {_ranked_sql('teacher_logit_backward')} AS rb FROM teacher)""",
    """judged AS (SELECT *, (ra + rb) * 0.5 AS m, abs(ra - rb) AS d FROM ranked)""",
    """prioritised AS (SELECT *, greatest((1 - target) * m, target * (1 - m), d * 0.8)
  AS teacher_priority, CASE WHEN (1 - target) * m >= target * (1 - m)
  THEN 'possible_false_negative' ELSE 'possible_false_positive' END AS teacher_reason FROM judged)""",
    f"""subset AS (SELECT * FROM (SELECT p.*, q.quota, row_number() OVER (PARTITION BY category
  ORDER BY teacher_priority DESC, {hash_sql(SEED, 'id1', 'id2')}, id1, id2) AS n
  FROM prioritised p JOIN quotas q USING (category)) WHERE n <= quota)""",
)


def _subset(spark, sf_dir):
    return mining.disagreement_subset(
        views.teacher(spark, sf_dir),
        "teacher_logit_forward",
        "teacher_logit_backward",
        quotas(spark, sf_dir),
        SEED,
        short="allow",
    )


@query(
    views.with_views(
        ["teacher"],
        QUOTA_SQL,
        *_PRIORITY_SQL,
        query=f"""SELECT id1, id2, category, {real('teacher_priority', 'teacher_priority')},
        teacher_reason FROM subset""",
    )
)
def disagreement_subset(spark, sf_dir):
    return _subset(spark, sf_dir).select(
        "id1", "id2", "category", "teacher_priority", "teacher_reason"
    )


@query(
    views.with_views(
        ["teacher"],
        QUOTA_SQL,
        *_PRIORITY_SQL,
        query=f"""SELECT category, teacher_reason, count(*) AS rows,
        {real('avg(teacher_priority)', 'mean_teacher_priority')},
        {real('avg(target)', 'mean_target')} FROM subset GROUP BY ALL""",
    )
)
def reason_summary(spark, sf_dir):
    return summaries.grouped_means(
        _subset(spark, sf_dir), ["category", "teacher_reason"], ["teacher_priority", "target"]
    )


COMBINED_SQL = """combined AS (SELECT *, 1 / (1 + exp(-greatest(least(teacher_logit, 40), -40)))
  AS teacher_probability FROM (SELECT *,
  (teacher_logit_forward + teacher_logit_backward) * 0.5 AS teacher_logit FROM teacher))"""
_REPLAY_SQL = (
    """prepared AS (SELECT *, 2 * abs(teacher_probability - 0.5) AS teacher_confidence,
  abs(teacher_probability - target) AS magnitude FROM combined)""",
    f"""replayed AS (SELECT *, 0.8 * teacher_probability + (1 - CAST(0.8 AS DOUBLE)) * target
  AS corrected FROM (SELECT p.*, q.quota, row_number() OVER (PARTITION BY category
  ORDER BY teacher_confidence * magnitude DESC, {hash_sql(SEED, 'id1', 'id2')}, id1, id2)
  AS n FROM prepared p JOIN quotas q USING (category)) WHERE n <= quota)""",
)


def _replay(spark, sf_dir):
    # Engines differ in the last digit of exp; rounding the input keeps order and ties equal.
    combined = combine_directions(views.teacher(spark, sf_dir)).withColumn(
        "teacher_probability", F.round("teacher_probability", 12)
    )
    return mining.corrected_replay(
        settle(combined), "teacher_probability", quotas(spark, sf_dir), SEED, short="allow"
    )


_ROUNDED_SQL = COMBINED_SQL.replace(
    "1 / (1 + exp(-greatest(least(teacher_logit, 40), -40)))",
    "round(1 / (1 + exp(-greatest(least(teacher_logit, 40), -40))), 12)",
)


@query(
    views.with_views(
        ["teacher"],
        QUOTA_SQL,
        _ROUNDED_SQL,
        *_REPLAY_SQL,
        query=f"""SELECT id1, id2, category, {real('target', 'organizer_target')},
        {real('corrected', 'target')}, {real('teacher_confidence', 'teacher_confidence')},
        {real('magnitude', 'teacher_correction_magnitude')} FROM replayed""",
    )
)
def corrected_replay(spark, sf_dir):
    return _replay(spark, sf_dir).select(
        "id1", "id2", "category", "organizer_target", "target", "teacher_confidence",
        "teacher_correction_magnitude",
    )


@query(
    views.with_views(
        ["teacher"],
        QUOTA_SQL,
        _ROUNDED_SQL,
        *_REPLAY_SQL,
        query=f"""SELECT category, count(*) AS rows, {real('avg(target)', 'mean_organizer_target')},
        {real('avg(teacher_probability)', 'mean_teacher_probability_used')},
        {real('avg(corrected)', 'mean_target')},
        {real('avg(teacher_confidence)', 'mean_teacher_confidence')},
        {real('avg(magnitude)', 'mean_teacher_correction_magnitude')}
        FROM replayed GROUP BY category""",
    )
)
def replay_summary(spark, sf_dir):
    return summaries.grouped_means(
        _replay(spark, sf_dir),
        ["category"],
        [
            "organizer_target", "teacher_probability_used", "target", "teacher_confidence",
            "teacher_correction_magnitude",
        ],
    )


@query(
    views.with_views(
        ["scored"],
        "numbered AS (SELECT *, row_number() OVER (ORDER BY id1, id2) - 1 AS source_row FROM scored)",
        query=f"""SELECT id1, id2, category, source_row FROM numbered QUALIFY row_number() OVER (
        PARTITION BY category ORDER BY {hash_sql(SEED, 'category', 'id1', 'id2', 'source_row')},
        source_row) <= 100""",
    )
)
def balanced_sample(spark, sf_dir):
    numbered = splits.source_rows(views.scored(spark, sf_dir).select("id1", "id2", "category"))
    return mining.balanced_sample(numbered, 100, SEED)


CHUNK, BATCH, FRACTION = 4096, 64, 0.3

_CHUNK_SQL = f"""chunked AS (SELECT s.*, (row_number() OVER (ORDER BY
  {hash_sql(SEED, 'id1', 'id2')}, id1, id2) - 1) // {CHUNK} AS chunk FROM training s)"""
_TRAINING_SQL = """training AS (SELECT id1, id2, category, soft_target AS target,
  surface_similarity, identity_conflicts, hard_negative_min_similarity,
  hard_positive_max_similarity FROM stressed)"""


def _drawn_sql(offset: int, *keys: str) -> str:
    group = ", ".join(["chunk", *keys])
    return f"""row_number() OVER (PARTITION BY {group}
  ORDER BY {hash_sql(SEED + offset, 'id1', 'id2')}, id1, id2)"""


_HARD_SQL = (
    THRESHOLDS_SQL,
    _TRAINING_SQL,
    _CHUNK_SQL,
    """kinds AS (SELECT *, CASE
  WHEN target <= 0.2 AND (surface_similarity >= hard_negative_min_similarity
    OR identity_conflicts > 0) THEN 'hard_negative'
  WHEN target >= 0.8 AND surface_similarity <= hard_positive_max_similarity THEN 'hard_positive'
  WHEN target <= 0.2 THEN 'easy_negative' ELSE 'other' END AS kind FROM chunked)""",
    """counted AS (SELECT *, count(*) OVER c AS n,
  count(*) FILTER (WHERE kind = 'hard_negative') OVER c AS hn,
  count(*) FILTER (WHERE kind = 'hard_positive') OVER c AS hp,
  count(*) FILTER (WHERE kind = 'easy_negative') OVER c AS en
  FROM kinds WINDOW c AS (PARTITION BY chunk))""",
    f"""sized AS (SELECT *, CASE WHEN hn + hp = 0 THEN 0 ELSE least(n - 1,
  greatest(1, CAST(round_even(n * CAST({FRACTION} AS DOUBLE), 0) AS BIGINT))) END AS replay
  FROM counted)""",
    """halved AS (SELECT *, (replay + 1) // 2 AS hard FROM sized)""",
    """shared AS (SELECT *, CASE WHEN hn = 0 THEN 0 WHEN hp = 0 THEN hard ELSE hard // 2 END AS whn,
  CASE WHEN en = 0 THEN 0 ELSE replay - hard END AS wen FROM halved)""",
    f"""needed AS (SELECT *, hard - whn AS whp, CASE kind WHEN 'hard_negative' THEN whn
  WHEN 'hard_positive' THEN hard - whn WHEN 'easy_negative' THEN wen ELSE 0 END AS need,
  count(*) OVER (PARTITION BY chunk, kind) AS have, {_drawn_sql(1, 'kind')} AS pos FROM shared)""",
    """classed AS (SELECT *, need // have + CASE WHEN pos <= need % have THEN 1 ELSE 0 END AS copies,
  replay - whn - whp - wen AS gap FROM needed)""",
    f"""spared AS (SELECT *, copies = 0 AS spare, count(*) FILTER (WHERE copies = 0)
  OVER (PARTITION BY chunk) AS rest, {_drawn_sql(3)} AS base_at FROM classed)""",
    f"""filled AS (SELECT *, CASE WHEN spare THEN gap // rest + CASE WHEN
  {_drawn_sql(2, 'spare')} <= gap % rest THEN 1 ELSE 0 END ELSE 0 END AS fill FROM spared)""",
    """emitted AS (
  SELECT id1, id2, category, chunk, 'base' AS source, 1 AS copy FROM filled WHERE base_at <= n - replay
  UNION ALL SELECT id1, id2, category, chunk, kind, unnest(range(1, copies + 1)) FROM filled
  UNION ALL SELECT id1, id2, category, chunk, 'fallback', unnest(range(1, fill + 1)) FROM filled)""",
)


def _hard(spark, sf_dir):
    scored = views.scored(spark, sf_dir)
    training = joins.with_category_parameters(
        scored,
        summaries.hard_pair_thresholds(scored),
        ["hard_negative_min_similarity", "hard_positive_max_similarity"],
    ).withColumn("target", F.col("soft_target"))
    chunked = batches.read_chunks(settle(training), CHUNK, SEED)
    return batches.hard_replay(chunked, FRACTION, SEED)


@query(
    views.with_views(
        ["scored"],
        *_HARD_SQL,
        query="""SELECT id1, id2, category, CAST(chunk AS BIGINT) AS chunk, source,
        CAST(copy AS BIGINT) AS copy FROM emitted""",
    )
)
def hard_replay(spark, sf_dir):
    return _hard(spark, sf_dir).select("id1", "id2", "category", "chunk", "source", "copy")


@query(
    views.with_views(
        ["scored"],
        *_HARD_SQL,
        f"""placed AS (SELECT *, chunk * {CHUNK} + row_number() OVER (PARTITION BY chunk
        ORDER BY id1 % 50, {hash_sql(SEED, 'id1', 'id2')}, id1, id2, source, copy) - 1 AS position
        FROM emitted)""",
        query=f"""SELECT id1, id2, source, CAST(copy AS BIGINT) AS copy,
        CAST(position // {BATCH} AS BIGINT) AS batch_id,
        CAST(position % {BATCH} AS BIGINT) AS batch_row,
        {hash_sql(SEED, f'CAST(position // {BATCH} AS BIGINT)')} AS batch_order FROM placed""",
    )
)
def training_batches(spark, sf_dir):
    """Batches of 64 by a stand-in text length, over the hard-replay rows."""
    rows = batches.batch_ids(_hard(spark, sf_dir), BATCH, CHUNK, F.col("id1") % 50, SEED)
    return rows.select("id1", "id2", "source", "copy", "batch_id", "batch_row", "batch_order")


_SHARE = 8  # round(32 * 0.2 / 0.8)


@query(
    views.with_views(
        ["human_pairs", "soft_pairs"],
        f"""first AS (SELECT id1, id2, target, (row_number() OVER (ORDER BY
        {hash_sql(SEED, 'id1', 'id2')}, id1, id2) - 1) // 32 AS batch_id FROM human_pairs)""",
        f"""supply AS (SELECT id1, id2, target, row_number() OVER (ORDER BY
        {hash_sql(SEED + 1, 'id1', 'id2')}, id1, id2) AS n FROM soft_pairs)""",
        f"""need AS (SELECT count(*) // 32 * {_SHARE} + CASE WHEN count(*) % 32 = 0 THEN 0 ELSE
        greatest(1, CAST(round_even((count(*) % 32) * CAST(0.2 AS DOUBLE) / CAST(0.8 AS DOUBLE), 0)
        AS BIGINT)) END AS rows FROM human_pairs)""",
        query=f"""SELECT 'primary' AS source, id1, id2, {real('target', 'target')},
        CAST(batch_id AS BIGINT) AS batch_id FROM first
        UNION ALL SELECT 'replay', id1, id2, round(target, 9), CAST((n - 1) // {_SHARE} AS BIGINT)
        FROM supply, need WHERE n <= need.rows""",
    )
)
def mixed_replay(spark, sf_dir):
    cards = views.items(spark, sf_dir)
    human = joins.with_category(views.human_pairs(spark, sf_dir), cards)
    soft = joins.with_category(views.soft_pairs(spark, sf_dir), cards)
    mixed = batches.mixed_replay(human, soft, 32, 0.2, SEED)
    return mixed.select("source", "id1", "id2", "target", "batch_id")


_SWAP = f"CAST({hash_sql(SEED, 'id1', 'id2')} AS DOUBLE) / 1152921504606846976.0 < 0.35"


@query(
    views.with_views(
        ["soft_pairs"],
        query=f"""SELECT CASE WHEN {_SWAP} THEN p.id2 ELSE p.id1 END AS id1,
        CASE WHEN {_SWAP} THEN p.id1 ELSE p.id2 END AS id2,
        CASE WHEN {_SWAP} THEN b.name ELSE a.name END AS left_name,
        CASE WHEN {_SWAP} THEN a.name ELSE b.name END AS right_name, {_SWAP} AS swapped
        FROM soft_pairs p JOIN items a ON a.id = p.id1
        JOIN items b ON b.id = p.id2""",
    )
)
def pair_swap(spark, sf_dir):
    joined = joins.pair_join(views.soft_pairs(spark, sf_dir), views.items(spark, sf_dir), ["name"])
    swapped = batches.swap_pairs(joined, 0.35, SEED)
    return swapped.select("id1", "id2", "left_name", "right_name", "swapped")
