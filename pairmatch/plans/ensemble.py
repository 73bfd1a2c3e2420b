"""Ensemble prediction: route, score, blend, correct, publish."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmatch.operators import audits
from pairmatch.operators.blending import blend_scores, rank_residual, with_length_route
from pairmatch.operators.scoring import Scorer, evidence_table, score_pairs
from pairmatch.session import settle, unbroadcast

CategoryWeights = Mapping[str, Sequence[float]]


@dataclass(frozen=True)
class Model:
    """A scorer factory by maximum text length, and its length routes by category."""

    name: str
    scorer: Callable[[int], Scorer]
    max_length: int = 256
    max_length_by_category: Mapping[str, int] = field(default_factory=dict)
    bidirectional: bool = False


@dataclass(frozen=True)
class Residual:
    model: Model
    categories: Sequence[str]
    reference_weight: float
    model_weight: float


@dataclass(frozen=True)
class Ensemble:
    """Blended models, and the optional residual and post-blend stages.

    ``weights`` is one vector or a vector per category in model order. ``post_blend``
    weighs the prediction against the model named, per category.
    """

    models: Sequence[Model]
    weights: Sequence[float] | CategoryWeights
    representation: str = "raw_logit"
    residual: Residual | None = None
    post_blend_model: str | None = None
    post_blend_weights: CategoryWeights | None = None


def _weight_rows(df: DataFrame, weights: CategoryWeights) -> DataFrame:
    rows = [(c, [float(w) for w in v]) for c, v in weights.items()]
    return df.sparkSession.createDataFrame(rows, "category string, weights array<double>")


def _active(ensemble: Ensemble, at: int) -> Column:
    """Rows on which a model's weight is not zero, in the blend or the post-blend."""
    name = ensemble.models[at].name
    if isinstance(ensemble.weights, Mapping):
        listed = [c for c, v in ensemble.weights.items() if v[at] > 0.0]
        used = F.col("category").isin(listed)
    else:
        used = F.lit(ensemble.weights[at] > 0.0)
    if ensemble.post_blend_model == name:
        late = [c for c, v in (ensemble.post_blend_weights or {}).items() if v[1] > 0.0]
        used = used | F.col("category").isin(late)
    return used


def _scores(texts: DataFrame, model: Model, active: Column) -> DataFrame:
    """``id1, id2, <model>``: routed scores of the active rows only."""
    rows = texts.where(active)
    routes = None
    if model.max_length_by_category:
        routes = texts.sparkSession.createDataFrame(
            list(model.max_length_by_category.items()), "category string, max_length int"
        )
    routed = with_length_route(rows, routes, model.max_length)
    parts = []
    for length in sorted({model.max_length, *model.max_length_by_category.values()}):
        part = routed.where(F.col("max_length") == length).drop("max_length")
        scored = score_pairs(part, model.scorer(length), model.bidirectional)
        parts.append(scored.select("id1", "id2", F.col("score").cast("float").alias(model.name)))
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table


def request_contract(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """One row of counts: what a prediction request must not hold, and its size."""
    ids = audits.item_table(items).select("null_ids", "duplicate_ids")
    known = items.where("id is not null").groupBy("id").agg(F.min("category").alias("category"))
    ends = pairs.groupBy("id1", "id2").agg(F.count(F.lit(1)).alias("n"))
    left = known.select(F.col("id").alias("id1"), F.lit(1).alias("l"), F.col("category").alias("cl"))
    right = known.select(F.col("id").alias("id2"), F.lit(1).alias("r"), F.col("category").alias("cr"))
    joined = ends.join(unbroadcast(left), "id1", "left").join(unbroadcast(right), "id2", "left")
    unknown = F.col("l").isNull() | F.col("r").isNull()
    rows = joined.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("requested_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_rows"),
        F.coalesce(F.sum(F.when(unknown, F.col("n"))), F.lit(0)).alias("unknown_item_rows"),
        F.coalesce(
            F.sum(F.when(~unknown & ~F.col("cl").eqNullSafe(F.col("cr")), F.col("n"))), F.lit(0)
        ).alias("cross_category_rows"),
    )
    return rows.select(
        "*", *[ids.select(n).scalar().alias(n) for n in ("null_ids", "duplicate_ids")]
    )


def predict(pairs: DataFrame, items: DataFrame, ensemble: Ensemble) -> DataFrame:
    """``id1, id2, predict``: one row for every requested row, repeated ones included.

    An empty request, null or repeated item ids, unknown items and pairs across categories
    are refused. Distinct pairs are scored once and joined back to the request. Item texts
    are derived once per item and settled with the joined pairs, then each model scores only
    the rows its weight reaches; an inactive row counts as 0.
    """
    found = request_contract(pairs, items)
    found = settle(found)
    audits.enforce(found, "null_ids", "duplicate_ids", "unknown_item_rows", "cross_category_rows")
    if not found.first()["requested_rows"]:
        raise ValueError("the request has no rows")
    request = pairs.select("id1", "id2")
    texts = settle(evidence_table(request.distinct(), items))
    table = texts.select("id1", "id2", "category")
    for at, model in enumerate(ensemble.models):
        scores = _scores(texts, model, _active(ensemble, at))
        table = table.join(unbroadcast(scores), ["id1", "id2"], "left")
    names = [m.name for m in ensemble.models]
    if ensemble.residual is not None:
        model = ensemble.residual.model
        inside = F.col("category").isin(list(ensemble.residual.categories))
        table = table.join(unbroadcast(_scores(texts, model, inside)), ["id1", "id2"], "left")
        names = [*names, model.name]
    # Scores feed several ranking passes: publish them once.
    table = settle(
        table.select(
            "id1", "id2", "category",
            *[F.coalesce(F.col(n), F.lit(0.0)).cast("double").alias(n) for n in names],
        )
    )
    weights = ensemble.weights
    if isinstance(weights, Mapping):
        weights = _weight_rows(table, weights)
    blended = blend_scores(
        table, [m.name for m in ensemble.models], weights, ensemble.representation
    )
    if ensemble.residual is not None:
        r = ensemble.residual
        blended = rank_residual(
            blended.withColumnRenamed("predict", "_reference"),
            "_reference", r.model.name, r.categories, r.reference_weight, r.model_weight,
        ).drop("_reference")
    if ensemble.post_blend_model is not None:
        blended = blend_scores(
            blended.withColumnRenamed("predict", "_prediction"),
            ["_prediction", ensemble.post_blend_model],
            _weight_rows(table, ensemble.post_blend_weights or {}),
            "category_rank",
        )
    return unbroadcast(request).join(unbroadcast(blended.select("id1", "id2", "predict")), ["id1", "id2"])
