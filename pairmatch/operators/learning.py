"""Training a soft-label matcher on pair evidence with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmatch.operators.metrics import average_precision, macro
from pairmatch.operators.summaries import category_counts, inverse_category_weights
from pairmatch.session import settle

FEATURES = (
    "surface_similarity",
    "identity_matches",
    "identity_conflicts",
    "missing_identity_fields",
)


def training_rows(
    df: DataFrame, features: Sequence[str] = FEATURES, confidence_gamma: float = 0.0
) -> DataFrame:
    """Weighted hard rows with the loss of the soft labels.

    A pair labelled y becomes a positive row of weight y and a negative one of weight
    1 - y, times its category weight and label confidence. Zero weights are dropped.
    """
    weights = inverse_category_weights(category_counts(df)).select("category", "weight")
    base: Column = F.col("weight")
    if confidence_gamma:
        base = base * F.pow(F.abs(2.0 * F.col("target") - 1.0), F.lit(confidence_gamma))
    weighted = df.join(weights, "category").select(
        "category",
        *features,
        F.inline(
            F.array(
                F.struct(F.lit(1.0).alias("label"), (base * F.col("target")).alias("row_weight")),
                F.struct(
                    F.lit(0.0).alias("label"), (base * (1.0 - F.col("target"))).alias("row_weight")
                ),
            )
        ),
    )
    return _assembled(weighted.where("row_weight > 0"), features)


def _assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    numbers = df.select("*", *[F.col(f).cast("double").alias(f"_{f}") for f in features])
    return VectorAssembler(
        inputCols=[f"_{f}" for f in features], outputCol="features"
    ).transform(numbers).drop(*[f"_{f}" for f in features])


def train_matcher(
    df: DataFrame,
    features: Sequence[str] = FEATURES,
    confidence_gamma: float = 0.0,
    regularisation: float = 1e-4,
    rounds: int = 200,
) -> LogisticRegressionModel:
    """Weighted logistic matcher; only its coefficients reach the driver.

    Raises if the fit is still moving after ``rounds``.
    """
    learner = LogisticRegression(
        weightCol="row_weight", regParam=regularisation, maxIter=rounds, standardization=True
    )
    model = learner.fit(training_rows(df, features, confidence_gamma))
    if model.summary.totalIterations >= rounds:
        raise RuntimeError(f"the matcher did not converge in {rounds} rounds")
    return model


def apply_matcher(
    model: LogisticRegressionModel, df: DataFrame, features: Sequence[str] = FEATURES
) -> DataFrame:
    """Add the matcher's logit as ``score``."""
    scored = model.transform(_assembled(df, features))
    return scored.select(
        *df.columns, vector_to_array("rawPrediction")[1].alias("score")
    )


def out_of_fold_scores(
    df: DataFrame,
    folds: Sequence[int],
    features: Sequence[str] = FEATURES,
    confidence_gamma: float = 0.0,
    regularisation: float = 1e-4,
) -> DataFrame:
    """Score every fold with a matcher trained on the others.

    The feature table is settled once and read by all fits.
    """
    table = settle(df.select("id1", "id2", "target", "category", "fold", *features))
    parts = []
    for fold in folds:
        held_out = F.col("fold") == fold
        model = train_matcher(table.where(~held_out), features, confidence_gamma, regularisation)
        parts.append(apply_matcher(model, table.where(held_out), features))
    return reduce(DataFrame.unionByName, parts)


def select_model(
    train: DataFrame,
    validation: DataFrame,
    grid: Sequence[tuple[float, float]],
    features: Sequence[str] = FEATURES,
    policy: str = "best",
) -> tuple[LogisticRegressionModel, DataFrame]:
    """Fit every (confidence, regularisation) pair and keep the best or the last one.

    Returns the model and ``confidence_gamma, regularisation, metric, chosen``, where the
    metric is macro average precision on the validation rows.
    """
    if policy not in ("best", "last"):
        raise ValueError(f"unknown selection policy: {policy}")
    spark = train.sparkSession
    train, validation = settle(train), settle(validation)
    tried = []
    for gamma, strength in grid:
        model = train_matcher(train, features, gamma, strength)
        scored = apply_matcher(model, validation, features)
        metric = macro(average_precision(scored, ["category"])).first()["macro_average_precision"]
        tried.append((model, gamma, strength, float(metric)))
    at = len(tried) - 1
    if policy == "best":
        at = max(range(len(tried)), key=lambda i: (tried[i][3], -i))
    rows = [(g, s, m, i == at) for i, (_, g, s, m) in enumerate(tried)]
    schema = "confidence_gamma double, regularisation double, metric double, chosen boolean"
    return tried[at][0], spark.createDataFrame(rows, schema)
