"""The registered queries: SQL where there is some, and the pipeline, over whole small tables."""

import collections
import re
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from check import cell
from pairmatch.llm.near_dup import classes
from pairmatch.llm.queries import RUN, SQL

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="test tables are not here")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    duck = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        duck.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    frame = RUN[name](spark, SF_DIR)
    columns = sorted(frame.columns)
    ours = sorted([cell(r[c]) for c in columns] for r in frame.collect())
    answer = duck.execute(SQL[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert ours == sorted([cell(r[i]) for i in order] for r in answer.fetchall())


def test_thirteen_queries():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in sorted(RUN, key=lambda n: int(re.match(r"op(\d+)_", n)[1]))] == list(range(1, 14))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.publish(stage(spark, docs, SF_DIR))
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns and docs.count() <= before.count()
        if name == "near duplicates":
            left = classes(docs, "doc_id", "text").collect()
            assert len({r.class_id for r in left}) == len(left)
        if name == "personal data":
            assert docs.count() == before.count()
            assert docs.where(r"text rlike '[a-z0-9]@[a-z0-9-]+\\.[a-z]'").count() == 0
    kept = {r.doc_id for r in seen["personal data"]}
    tokens = collections.Counter()
    for r in seen["packing"]:
        tokens[r.doc_id] += r.length
    assert set(tokens) == kept
    assert all(tokens[r.doc_id] == r.doc_tokens for r in seen["packing"])
    run = corpus_pipeline.run(spark, SF_DIR).collect()
    key = lambda rows: sorted((r.doc_id, r.start, r.length, bytes(r.ids)) for r in rows)
    assert key(run) == key(seen["packing"])
