"""The SQL check of check.py on a few queries; PAIRMATCH_ALL=1 runs every one of them."""

import os
from pathlib import Path

import duckdb
import pytest

from check import cell
from pairmatch.catalogue import QUERIES

SF_DIR = "/root/testdata/sf0.001"
QUICK = (
    "bucketed_pair_join", "footer_counts", "pruned_folds", "fold_contract", "ordered_predictions", "lineage_ranges",
    "lineage_differences", "validated_scores", "calibration_job",
    "pair_join", "surface_similarity", "macro_average_precision", "metric_by_fold",
    "percentile_rank_fold", "hash_split", "contract_mismatch", "attribute_pairs",
    "blend_category", "mixed_replay", "apply_calibration",
)
NAMES = list(QUERIES) if os.environ.get("PAIRMATCH_ALL") else QUICK

pytestmark = pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    frame = QUERIES[name].run(spark, SF_DIR)
    columns = sorted(frame.columns)
    ours = sorted([cell(r[c]) for c in columns] for r in frame.collect())
    if QUERIES[name].sql is None:
        return
    answer = duck.execute(QUERIES[name].sql)
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert ours == sorted([cell(r[i]) for i in order] for r in answer.fetchall())
