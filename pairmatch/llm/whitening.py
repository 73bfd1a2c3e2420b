"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Entries become whole numbers on a grid, so sums are exact and equal vectors are equal. The
fit list (every distinct vector once) is written as blocks of centred offsets, and each step
reads them once: a task forms u = Xv of its rows and adds up its part of X'u, so that one
vector as long as a row is all that leaves a task. The left vectors u are never stored: each
is X times a short vector of coefficients, and their products with a new one follow from the
sums X'u that are at hand. Both sides are orthogonalised against all earlier vectors, twice.
The small matrix U'XV is bidiagonal up to these corrections; its singular value decomposition
gives the components and their deviations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmatch.llm.common import publish, query, quoted, table


@dataclass(frozen=True)
class Grid:
    """Entries become floor(``scale`` * entry) + ``offset``."""

    scale: int = 64
    offset: int = 1_000_000


@dataclass
class Whitening:
    """A fitted transform: ``vectors`` has a unit component per column, ``values`` falling eigenvalues."""

    n: int
    sums: list[int]
    vectors: object
    values: object
    trace: float
    identity_error: float
    steps: int


def on_grid(rows: DataFrame, key: str, vector: str, grid: Grid) -> DataFrame:
    """``id, x``: the rows whose vector is not null and has finite entries only, on the grid.

    The key may be null; an empty vector stays and has no components. An entry whose grid
    value leaves the 64-bit whole numbers fails the job.
    """
    values = quoted(vector).cast("array<double>")
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    placed = F.transform("x", lambda c: F.floor(F.lit(float(grid.scale)) * c) + F.lit(grid.offset).cast("long"))
    return (
        rows.select(quoted(key).cast("long").alias("id"), values.alias("x"))
        .where(F.col("x").isNotNull() & fine)
        .select("id", placed.cast("array<long>").alias("x"))
    )


def _matrix(column):
    """A batch's list column as a matrix of whole numbers."""
    import numpy as np

    flat, ends = column.flatten(), np.diff(column.offsets.to_numpy())
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), int(ends[0]) if len(ends) else 0)


def _sizes(rows: DataFrame) -> int:
    """The one length of all vectors; 0 for an empty table."""
    got = [r["size"] for r in rows.select(F.size("x").alias("size")).distinct().limit(2).collect()]
    if len(got) > 1:
        raise ValueError(f"the vectors have several lengths, such as {sorted(got)}")
    return got[0] if got else 0


def distinct_blocks(rows: DataFrame, size: int, block: int = 2048) -> tuple[int, list[int], DataFrame]:
    """Number and sums of the distinct vectors, and a table ``shift, cells`` of their blocks.

    A block holds up to ``block`` vectors less the whole part of their mean, in 32 bits an
    entry, or in 64 where the entries lie farther apart.
    """
    once = publish(rows.select("x").distinct())
    sums = once.select(F.posexplode("x").alias("place", "v")).groupBy("place").agg(
        F.sum("v").alias("total"), F.count(F.lit(1)).alias("n")
    )
    got = {r["place"]: (r["total"], r["n"]) for r in sums.collect()}
    n, totals = (got[0][1] if got else 0), [got[j][0] for j in range(size if got else 0)]
    if not n:
        return 0, [], once
    shift = [s // n for s in totals]

    def pack(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        base = np.array(shift, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = _matrix(batch.column(0)) - base
            parts = [cells[a : a + block] for a in range(0, len(cells), block)]
            wide = [bool((np.abs(p) >= 1 << 31).any()) for p in parts]
            packed = [p.astype(np.int64 if w else np.int32).tobytes() for p, w in zip(parts, wide)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(p) for p in parts], pa.int64()), pa.array(packed, pa.binary())], names=["rows", "cells"]
            )

    return n, totals, publish(once.mapInArrow(pack, "rows long, cells binary"))


def _centred(batches: Iterator, size: int, rest) -> Iterator:
    """The centred rows of every block."""
    import numpy as np

    for batch in batches:
        for count, cells in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = np.frombuffer(cells.as_buffer(), np.int32 if len(cells.as_buffer()) == 4 * count * size else np.int64)
            yield raw.reshape(count, size) - rest


def _summed(blocks: DataFrame, size: int, rest, width: int, part) -> object:
    """The sum over all blocks of ``part(rows)``, an array of ``width`` numbers."""
    import numpy as np

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(width)
        for rows in _centred(batches, size, rest):
            total += part(rows)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total)], names=["place", "v"])

    rows = blocks.mapInArrow(run, "place long, v double").groupBy("place").agg(F.sum("v").alias("v"))
    out = np.zeros(width)
    for r in rows.collect():
        out[r["place"]] = r["v"]
    return out


def bidiagonalise(product, size: int, wanted: int, seed: int = 9, tolerance: float = 1e-14):
    """The leading right singular vectors and singular values of X, and the number of steps.

    ``product(v)`` gives X'Xv by way of u = Xv. With V the right vectors, U = XW the left ones
    and Z = X'U, every step adds a column to each: U'Xv = Z'v are the coefficients against the
    earlier left vectors, the rest of X'u against the earlier right ones gives the next v. A
    vanishing rest starts anew with a random direction, so that repeated values are found
    as well. The leading values have settled when |X'u - s v| is below ``tolerance`` times the
    largest one; random directions then get a few steps each to show a value that was missed,
    until one changes nothing. After ``size`` steps nothing is left.
    """
    import numpy as np

    rng = np.random.default_rng(seed)
    right, coefficients, back = (np.empty((size, 0)) for _ in range(3))
    small = np.zeros((0, 0))

    def against(x):
        for _ in range(2):
            x = x - right @ (right.T @ x)
        return x

    def anew():
        for _ in range(20):
            x = against(rng.standard_normal(size))
            if np.linalg.norm(x) > 1e-8:
                return x / np.linalg.norm(x)
        raise RuntimeError("no direction is left")

    if not size:
        return right, np.empty(0), 0
    v, top, seen, again = anew(), 0.0, [], wanted + 1
    while right.shape[1] < size:
        w, z, along = v, product(v), np.zeros(back.shape[1])
        for turn in range(2):
            c = back.T @ v if turn == 0 else coefficients.T @ z
            w, z, along = w - coefficients @ c, z - back @ c, along + c
        square = float(w @ z)
        alpha = np.sqrt(max(square, 0.0))
        right = np.column_stack([right, v])
        kept = alpha > 1e-13 * max(top, np.linalg.norm(along), 1e-300)
        grown = np.zeros((small.shape[0] + kept, small.shape[1] + 1))
        grown[: small.shape[0], :-1] = small
        grown[: len(along), -1] = along
        if kept:
            grown[-1, -1] = alpha
            coefficients, back = np.column_stack([coefficients, w / alpha]), np.column_stack([back, z / alpha])
        small = grown
        left, values, turned = np.linalg.svd(small, full_matrices=False)
        top = values[0] if len(values) else 0.0
        steps, lead = right.shape[1], slice(0, wanted)
        if steps == size:
            break
        rest = back @ left[:, lead] - right @ turned.T[:, lead] * values[lead]
        if np.linalg.norm(rest, axis=0).max(initial=0.0) <= tolerance * size * top and steps >= again:
            if len(seen) == len(values[lead]) and np.allclose(seen, values[lead], rtol=1e-9, atol=0):
                break
            seen, again, v = values[lead], steps + max(8, wanted // 2), anew()
            continue
        after = against(back[:, -1]) if kept else np.zeros(size)
        beta = np.linalg.norm(after)
        v = after / beta if beta > 1e-13 * max(top, 1e-300) else anew()
    return right @ turned.T[:, :wanted], values[:wanted], right.shape[1]


def fit(rows: DataFrame, wanted: int = 16) -> Whitening | None:
    """The transform of ``rows(x)``; None if there are no rows or all are equal.

    Components without variance (an eigenvalue below 1e-12 of the largest) are left out.
    """
    import numpy as np

    size = _sizes(rows)
    n, sums, blocks = distinct_blocks(rows, size)
    if n < 2:
        return None
    # The mean's whole part is in the blocks already.
    rest = np.array([(s % n) / n for s in sums])
    trace = float(_summed(blocks, size, rest, size, lambda x: (x * x).sum(axis=0)).sum()) / n

    def product(v):
        def part(x):
            u = x @ v
            return x.T @ u

        return _summed(blocks, size, rest, size, part)

    vectors, deviations, steps = bidiagonalise(product, size, min(wanted, size))
    values = deviations**2 / n
    kept = values > 1e-12 * values[0]
    vectors, values = vectors[:, kept], values[kept]
    count = len(values)
    scaled = vectors / np.sqrt(values)

    def gram(x):
        y = x @ scaled
        return (y.T @ y).ravel()

    error = np.abs(_summed(blocks, size, rest, count * count, gram).reshape(count, count) / n - np.eye(count)).max()
    return Whitening(n, sums, vectors, values, trace, float(error), steps)


def whiten(rows: DataFrame, model: Whitening | None) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error`` of ``rows(id, x)``."""
    schema = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        n, count = model.n, len(model.values)
        shift, rest = np.array([s // n for s in model.sums], np.int64), np.array([s % n for s in model.sums], np.int64)
        scaled = model.vectors / np.sqrt(model.values)
        for whole_batch in batches:
            for first in range(0, whole_batch.num_rows, 1024):
                batch = whole_batch.slice(first, 1024)
                cells = _matrix(batch.column(1)) - shift
                far = n * cells.astype(np.float64) - rest
                if float((far * far).sum(axis=1).max()) >= 2.0**62:
                    raise OverflowError("a squared deviation leaves the 64-bit whole numbers")
                exact = n * cells - rest
                columns = [
                    batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), count))),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), batch.num_rows)),
                    pa.array(np.full(batch.num_rows * count, n)),
                    pa.array(np.repeat((exact * exact).sum(axis=1), count)),
                    pa.array(((exact / n) @ scaled).ravel()),
                    pa.array(np.tile(model.values / model.trace, batch.num_rows)),
                    pa.array(np.full(batch.num_rows * count, model.identity_error)),
                ]
                names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, schema)


def whitened(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", wanted: int = 16, grid: Grid = Grid()
) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error`` per row and component.

    Rows with a null vector, or null or non-finite entries, are dropped; all others are
    transformed, whatever their key (null and repeated ones too). The fit list is each
    distinct grid vector once, so copies don't weigh. Vectors of several lengths raise.
    Components without variance are left out: a table of fewer than two different vectors
    gives no rows. Repeated eigenvalues give some orthogonal components of their space.
    Other columns are not read.
    """
    rows = publish(on_grid(vectors, key, vector, grid))
    return whiten(rows, fit(rows, wanted))


@query()
def op13_lanczos_whitening(spark, sf_dir):
    """Every usable embedding on the 16 leading components, whitened."""
    return whitened(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
