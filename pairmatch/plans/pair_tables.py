"""Training, validation and human pair tables with their audits and manifest."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmatch.operators import audits, joins, splits, summaries
from pairmatch.sources.tables import write_parquet


@dataclass(frozen=True)
class PairTableConfig:
    validation_modulus: int = 5
    validation_bucket: int = 0
    #: 1 keeps every training pair; a larger number keeps one of so many.
    train_sample_modulus: int = 1
    sample_seed: int = 2026
    row_group_bytes: int | None = None
    hash_method: str = "md5"


def pair_tables(
    soft: DataFrame,
    items: DataFrame,
    human_folds: DataFrame,
    human_items: DataFrame,
    config: PairTableConfig = PairTableConfig(),
) -> dict[str, DataFrame]:
    """The three joined tables: sampled soft training pairs, held-out soft pairs, humans."""
    method = config.hash_method
    split = splits.hash_split(config.validation_modulus, config.validation_bucket, method)
    marked = soft.select("id1", "id2", "target", split.alias("split"))
    train = splits.modulus_sample(
        marked.where("split = 'train'").drop("split"),
        config.train_sample_modulus,
        config.sample_seed,
        method,
    )
    chosen = {
        "soft_train": (train, items),
        "soft_validation": (marked.where("split = 'validation'").drop("split"), items),
        "human_all": (
            human_folds.select("id1", "id2", "target", "component_id", "fold"),
            human_items,
        ),
    }
    return {
        name: joins.with_surface_similarity(joins.pair_join(pairs, cards))
        for name, (pairs, cards) in chosen.items()
    }


def split_counts(soft: DataFrame, config: PairTableConfig = PairTableConfig()) -> DataFrame:
    split = splits.hash_split(
        config.validation_modulus, config.validation_bucket, config.hash_method
    )
    return soft.groupBy(split.alias("split")).agg(F.count(F.lit(1)).alias("rows"))


def manifest(
    tables: Mapping[str, DataFrame],
    soft: DataFrame,
    human: DataFrame,
    config: PairTableConfig = PairTableConfig(),
) -> DataFrame:
    """``dataset, metric, value``: table statistics, split counts and item overlap."""
    parts = [
        summaries.tidy(summaries.dataset_summary(table), name) for name, table in tables.items()
    ]
    parts.append(
        split_counts(soft, config).select(
            F.lit("soft_source").alias("dataset"),
            F.concat(F.lit("rows_"), "split").alias("metric"),
            F.col("rows").cast("double").alias("value"),
        )
    )
    parts.append(summaries.tidy(summaries.item_overlap(soft, human), "item_overlap"))
    return summaries.stack(parts)


def write_pair_tables(
    spark: SparkSession,
    soft: DataFrame,
    items: DataFrame,
    human_folds: DataFrame,
    human_items: DataFrame,
    path: str,
    config: PairTableConfig = PairTableConfig(),
    overwrite: bool = False,
) -> DataFrame:
    """Write the tables, audit what was written, and write and return the manifest.

    Fails when the sources share items, when a required field is null, when a pair
    crosses categories or when a similarity leaves [0, 1].
    """
    audits.enforce(summaries.item_overlap(soft, human_folds), "shared_items")
    built = pair_tables(soft, items, human_folds, human_items, config)
    written = {}
    for name, table in built.items():
        target = f"{path}/{name}"
        write_parquet(table, target, row_group_bytes=config.row_group_bytes, overwrite=overwrite)
        written[name] = spark.read.parquet(target)
        audits.enforce(
            summaries.dataset_summary(written[name]),
            "required_null_rows",
            "category_mismatch_rows",
            "invalid_surface_similarity_rows",
        )
    report = manifest(written, soft, human_folds, config)
    report.write.mode("overwrite" if overwrite else "errorifexists").json(f"{path}/manifest")
    return spark.read.schema(report.schema).json(f"{path}/manifest")
