import numpy as np
import pytest
from pyspark.sql import functions as F

from pairmatch.llm.whitening import Grid, bidiagonalise, whitened


def plain(vectors, wanted=16):
    """Per-row whitened values, deviations and shares by an eigendecomposition of the distinct rows."""
    x = np.floor(64 * np.asarray(vectors, float)) + 1_000_000
    once = np.unique(x, axis=0)
    mean = once.mean(axis=0)
    values, parts = np.linalg.eigh(np.cov((once - mean).T, bias=True).reshape(x.shape[1], -1))
    values, parts = values[::-1], parts[:, ::-1]
    kept = values[:wanted] > 1e-12 * values[0]
    y = (x - mean) @ parts[:, :wanted][:, kept] / np.sqrt(values[:wanted][kept])
    deviation = [sum(int(c) ** 2 for c in row) for row in len(once) * x - once.sum(axis=0)]
    return y, deviation, values[:wanted][kept] / values.sum(), len(once)


@pytest.mark.parametrize("shape", ["flat", "falling", "few rows"])
def test_whitened_rows_equal_an_eigendecomposition(spark, shape):
    rng = np.random.default_rng(4)
    data = rng.standard_normal({"flat": (400, 24), "falling": (300, 60), "few rows": (9, 40)}[shape])
    if shape == "falling":
        data *= 5 * 0.85 ** np.arange(60)
    data = np.concatenate([data, data[:50], np.repeat(data[:1], 100, axis=0)])
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("x", F.lit(0))
    got = {}
    for r in whitened(df.repartition(5)).collect():
        got.setdefault(r.id, {})[r.component] = r
    y, deviation, share, n = plain(data)
    assert set(got) == set(range(len(data)))
    mine = np.array([[got[i][c].whitened for c in range(1, y.shape[1] + 1)] for i in range(len(data))])
    signs = np.sign((mine * y).sum(axis=0))
    assert all(set(r) == set(range(1, y.shape[1] + 1)) for r in got.values())
    assert np.abs(mine - signs * y).max() < 1e-7
    assert [got[i][1].deviation for i in range(len(data))] == deviation
    assert np.allclose([got[0][c].explained for c in range(1, y.shape[1] + 1)], share, rtol=1e-9)
    assert {(r[1].n, r[1].identity_error < 1e-9) for r in got.values()} == {(n, True)}


@pytest.mark.parametrize(
    "values", [[3.0] * 5 + [2.0] * 20 + [1.0] * 15, [1.0] * 30, [10.0, 1.0, 1e-7, 0.0], list(0.9 ** np.arange(80))]
)
def test_repeated_and_vanishing_values_are_found(values):
    rng = np.random.default_rng(2)
    data = np.linalg.qr(rng.standard_normal((200, len(values))))[0] * np.array(values)
    data = data @ np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
    wanted = min(16, len(values))
    vectors, found, steps = bidiagonalise(lambda v: data.T @ (data @ v), len(values), wanted)
    assert steps <= len(values)
    assert np.allclose(found, np.sort(values)[::-1][:wanted], rtol=1e-7, atol=1e-7 * max(values))
    assert np.abs(vectors.T @ vectors - np.eye(wanted)).max() < 1e-12
    strong = found > 1e-6 * found[0]
    assert np.allclose(np.linalg.norm(data @ vectors, axis=0)[strong], found[strong], rtol=1e-6)


def test_settles_early_on_a_falling_spectrum():
    data = np.random.default_rng(1).standard_normal((500, 300)) * 0.7 ** np.arange(300)
    assert bidiagonalise(lambda v: data.T @ (data @ v), 300, 16)[2] < 80


def test_unusable_rows_equal_rows_and_empty_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (None, [1.5, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [0.0, 0.0]), (8, [1.0, None])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitened(df).collect()
    assert sorted((r.id or 0, r.component) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (7, 1), (7, 2)]
    assert {r.n for r in got} == {3}
    assert whitened(df.limit(0)).count() == 0
    # One distinct vector has no variance, whatever the number of its copies; one dimension may have none.
    assert whitened(df.where("vec_id = 1")).count() == 0
    flat = spark.createDataFrame([(i, [float(i), 3.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert {r.component for r in whitened(flat).collect()} == {1}
    with pytest.raises(ValueError, match="several lengths"):
        whitened(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], df.schema))
    far = spark.createDataFrame([(i, [float(i) * 1e8, 0.0]) for i in range(3)], df.schema)
    with pytest.raises(Exception, match="squared deviation"):
        whitened(far).count()
    assert whitened(far, grid=Grid(scale=1, offset=0)).count() == 3
