"""Approximate nearest neighbours by collision counting over single random projections.

Every vector is projected on ``projections`` random lines. A block of vectors keeps one
sorted array per line. A query opens a window around its own projection on every line and
counts, for each vector, the lines on which it lies inside: near vectors collide often, far
ones seldom. Virtual rehashing widens all windows by a factor per round. A vector whose count
reaches the threshold is verified with its exact distance. A query is done in a block when its
k-th verified distance is within ``ratio`` times the half width of the round, or when every
vector was verified.

Only near vectors can be among the k or end a round, and a lower bound of all distances, one
matrix product in single precision, costs far less than counting on every line. So collisions
are counted for the vectors below a bound that is widened until no vector beyond it could
change the outcome: the rows are those of counting for all vectors. Every pair of a query and
a vector still passes that product, so the work grows with queries times vectors.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from pairmatch.llm.common import query, quoted, table
from pairmatch.session import few_rows, settle, shuffle_width


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, vec`` of the vectors that take part: not null, not zero, all components finite.

    Components are single precision where the table's are, else double.
    """
    kind = vectors.select(quoted(vector)).schema[0].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    vec = quoted(vector).cast("array<float>" if single else "array<double>")
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(quoted(key).cast("long").alias("id"), vec.alias("vec")).where(
        F.col("id").isNotNull()
        & F.col("vec").isNotNull()
        & fine
        & F.exists("vec", lambda x: x != 0)
    )


class _Block:
    """One block of vectors: its sorted projections, and what screens distances to it.

    Lines have standard normal components, so a difference of length d is projected to a
    normal number of deviation d, and distances and half widths are on one scale.

    A vector can only be among the k of a query, or decide how far its windows widen, if it
    is near. ``screen`` times a query gives a lower bound of every squared distance, in single
    precision about the block's mean: products differ from the exact value by at most ``slack``
    times the two squared norms. Collisions are counted for the vectors below a bound of the
    query, and the search says whether others could have changed its outcome.
    """

    #: Vectors and queries of one product: the tile stays in a core's cache.
    TILE, QUERIES = 1024, 256

    def __init__(self, ids, base, lines, k, opening, reach):
        import numpy as np

        order = np.argsort(ids, kind="stable")  # rows arrive in any order; the index must not depend on it
        self.ids, self.base, self.lines, self.k = ids[order], base[order].astype(np.float64), lines, k
        self.placed = self.base @ lines
        self.ladder = np.sort(self.placed, axis=0).T.copy()
        self.aside = max(k, int(len(ids) * opening / 2))
        # A scale for queries as well, so that single precision neither overflows nor loses the sign of a bound.
        self.scale = 2 * max(float(np.abs(self.base).max()), reach)
        self.middle = (self.base / self.scale).mean(axis=0)
        self.rows = self._apart()
        points = (self.base[self.rows] / self.scale - self.middle).astype(np.float32)
        self.slack = min(1.0, 2.4e-7 * (points.shape[1] + 8))
        norms = (points**2).sum(axis=1) * np.float32(1 - self.slack)
        self.screen = np.column_stack([-2 * points, norms, np.ones_like(norms)])
        self.sample = np.ascontiguousarray(self.screen[:: -(-len(norms) // 4096)])

    def _apart(self):
        """The rows to look at: of more than 2 k copies of one vector the smallest ids, k rows of each at most.

        Copies lie at one distance and are ranked by id, so that no other row is among the k
        nearest that are not the query's own.
        """
        import numpy as np

        bits = self.base.view(np.uint64)
        mixed = (bits * np.random.default_rng(1).integers(1, 1 << 63, bits.shape[1], dtype=np.uint64)).sum(axis=1)
        order = np.argsort(mixed, kind="stable")
        first = np.flatnonzero(np.r_[True, mixed[order][1:] != mixed[order][:-1]])
        rows = np.ones(len(mixed), bool)
        ends = np.r_[first[1:], len(mixed)]
        many = ends - first > 2 * self.k
        for a, b in zip(first[many], ends[many]):
            if (bits[order[a:b]] == bits[order[a]]).all():
                names = self.ids[order[a:b]]
                few = np.arange(b - a) - np.searchsorted(names, names) < self.k
                rows[order[a:b]] = few & (np.cumsum(few) <= 2 * self.k)
        return np.flatnonzero(rows)

    def _asked(self, points):
        import numpy as np

        flat = (points / self.scale - self.middle).astype(np.float32)
        norms = (flat**2).sum(axis=1) * np.float32(1 - self.slack)
        return np.column_stack([flat, np.ones_like(norms), norms])

    def _opened(self, spots):
        """Half widths of the first windows: they hold the share ``opening`` of the block on the median line."""
        import numpy as np

        last = len(self.ids) - 1
        spans = np.empty(spots.T.shape)
        for span, line, x in zip(spans, self.ladder, spots.T):
            order = x.argsort()  # sorted, the searches stay near each other
            at = np.empty(len(x), np.int64)
            at[order] = line.searchsorted(x[order])
            up, down = line[np.minimum(last, at + self.aside)], line[np.maximum(0, at - self.aside)]
            np.maximum(np.abs(up - x), np.abs(down - x), out=span)
        return np.maximum(np.median(spans, axis=0), 1e-12)

    def _ranked(self, flat, lower, some):
        """A bound of the squared distance for each query: the value of the vector of rank ``some`` of ``lower``."""
        import numpy as np

        if some >= lower.shape[1]:
            return np.full(len(flat), np.inf)
        bound = np.partition(lower, some - 1, axis=1)[:, some - 1].astype(np.float64)
        return np.maximum(bound + 4 * self.slack * flat[:, -1], 0) * self.scale**2

    def _below(self, flat, bound):
        """Pairs (query, row) whose squared distance may be up to ``bound``, none missing, and a lower bound of it."""
        import numpy as np

        limit = (bound / self.scale**2 * (1 + 1e-6) + 1e-30).astype(np.float32)
        asked, rows, least = [], [], []
        for at in range(0, len(self.screen), self.TILE):
            lower = self.screen[at : at + self.TILE] @ flat.T
            near = lower <= limit
            if near.size % 64 == 0:  # few are near: find the words of 64 bits that are not zero first
                word = np.flatnonzero(np.packbits(near).view(np.uint64))
                bit = np.flatnonzero(near.reshape(-1, 64)[word])
                hit = word[bit // 64] * 64 + bit % 64
            else:
                hit = np.flatnonzero(near)
            asked.append(hit % len(flat))
            rows.append(hit // len(flat) + at)
            least.append(lower.ravel()[hit])
        least = np.concatenate(least).astype(np.float64) * self.scale**2
        return np.concatenate(asked), self.rows[np.concatenate(rows)], least

    def search(self, own, points, bounds, limit, need, ratio, widen):
        """The k nearest found for each query: query, row, distance; ``bounds`` are read and renewed in place.

        Windows open at the query's own projections and widen from round to round. A vector
        is verified in the first round whose windows hold it on ``need`` lines; a query is done
        when its k-th verified distance is within ``ratio`` half widths. If vectors beyond the
        bound could be the k-th, the query is asked again with a wider one. Vectors farther than
        ``limit``, the k-th distance known from other blocks, may be left out of the result; the
        second row of ``bounds`` is for queries that have such a limit.
        """
        import numpy as np

        flat, spots, half = self._asked(points), points @ self.lines, np.full(len(own), np.nan)
        same = self.ids.searchsorted(own, "right") - self.ids.searchsorted(own)
        wanted = np.minimum(self.k, len(self.ids) - same)
        some = 2 * self.k + 4
        bound, tight = bounds
        new = np.flatnonzero(np.isnan(bound))
        whole, part = len(self.screen), len(self.sample)
        rank = some if part == whole else -(-some * part // whole) + 2
        for at in range(0, len(new), self.QUERIES):
            turn = new[at : at + self.QUERIES]
            bound[turn] = self._ranked(flat[turn], flat[turn] @ self.sample.T, rank)
        easy = (wanted == self.k) & np.isfinite(limit)
        out, hard = self._limited(easy, own, points, spots, flat, half, tight, limit, need, ratio, widen)
        todo = np.concatenate([np.flatnonzero((wanted > 0) & ~easy), hard])
        first = todo[np.isnan(half[todo])]
        half[first] = self._opened(spots[first])
        size = self.QUERIES
        while len(todo):
            again = []
            for at in range(0, len(todo), size):
                turn = todo[at : at + size]
                found, lacking = self._rounds(
                    own[turn], points[turn], spots[turn], flat[turn], half[turn], wanted[turn], bounds, turn,
                    some, need, ratio, widen,
                )
                out.append(found)
                again.append(lacking)
            todo = np.concatenate(again)
            some *= 8
            size = max(1, min(64, 32768 // some))
            for at in range(0, len(todo), 64):
                turn = todo[at : at + 64]
                bound[turn] = self._ranked(flat[turn], flat[turn] @ self.screen.T, some)
        return [np.concatenate(x) for x in zip(*out)]

    def _verified(self, q, v, points, spots, need):
        """Exact distances, and the half widths at which the vectors' counts of collisions reach ``need``."""
        import numpy as np

        far, meets = np.empty(len(q)), np.empty(len(q))
        for at in range(0, len(q), self.TILE):
            part = slice(at, at + self.TILE)
            apart = self.base.take(v[part], axis=0)
            apart -= points.take(q[part], axis=0)
            far[part] = np.sqrt(np.square(apart, out=apart).sum(axis=1))
            apart = self.placed.take(v[part], axis=0)
            apart -= spots.take(q[part], axis=0)
            np.abs(apart, out=apart).partition(need - 1, axis=1)
            meets[part] = apart[:, need - 1]
        return far, meets

    def _renewed(self, bound, starts, squares, some):
        """Bounds for the next block, which is much like this one: they leave about ``some`` of its vectors."""
        import numpy as np

        many = np.diff(starts) >= some
        after = bound * 1.02
        after[many] = (bound[many] + np.maximum(squares[starts[:-1][many] + some - 1], 0)) / 2
        return np.where(np.isfinite(after), after, np.nan)

    def _limited(self, easy, own, points, spots, flat, half, bound, limit, need, ratio, widen):
        """The vectors within ``limit`` where it is sure that they are verified, and the queries where it isn't.

        The k-th verified distance is at least the k-th lower bound, and a query is done in a
        round in which ``ratio`` half widths reach it; a vector that such windows hold often
        enough is verified at the end, whatever the rounds are.
        """
        import numpy as np

        most = limit**2 * (1 + 1e-6) + 1e-30 * self.scale**2
        reach, kept = np.fmax(bound, most), []
        useful, easy = np.zeros(len(own), bool), np.flatnonzero(easy)
        for at in range(0, len(easy), self.QUERIES):
            turn = easy[at : at + self.QUERIES]
            q, v, least = self._below(flat[turn], reach[turn])
            q = turn[q]
            close = np.flatnonzero(least <= most[q])
            useful[q[close[self.ids[v[close]] != own[q[close]]]]] = True
            keep = np.flatnonzero(useful[q])
            keep = keep[self.ids[v[keep]] != own[q[keep]]]
            kept.append((q[keep], v[keep], least[keep]))
        turn = np.flatnonzero(useful)
        if not len(turn):
            return [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))], turn
        q, v, least = (np.concatenate(x) for x in zip(*kept))
        order = np.lexsort((least, q))
        q, v, least = q[order], v[order], least[order]
        starts = np.r_[q.searchsorted(turn), len(q)]
        kth = reach[turn] * (1 - 1e-9)
        full = np.diff(starts) >= self.k
        kth[full] = np.minimum(kth[full], least[starts[:-1][full] + self.k - 1])
        widest = np.full(len(own), np.nan)
        widest[turn] = np.sqrt(np.maximum(kth, 0)) * (1 - 1e-9) / ratio
        bound[turn] = self._renewed(bound[turn], starts, least, self.k)
        use = least <= most[q]
        q, v = q[use], v[use]
        far, meets = self._verified(q, v, points, spots, need)
        use = far <= limit[q]
        q, v, far, meets = q[use], v[use], far[use], meets[use]
        turn = np.unique(q[meets > widest[q]])
        half[turn] = self._opened(spots[turn])
        last = half[turn]
        while (early := last < widest[turn]).any():
            last[early] *= widen
        widest[turn] = last
        unsure = np.zeros(len(own), bool)
        unsure[q[meets > widest[q]]] = True
        sure = ~unsure[q]
        return [(q[sure], v[sure], far[sure])], np.flatnonzero(unsure)

    def _rounds(self, own, points, spots, flat, half, wanted, bounds, turn, some, need, ratio, widen):
        """The k nearest verified round by round, and the queries for which vectors beyond the bound count."""
        import numpy as np

        bound = bounds[0, turn]
        q, v, _ = self._below(flat, bound)
        far, meets = self._verified(q, v, points, spots, need)
        reach = np.sqrt(bound) * (1 - 1e-9)
        keep = np.flatnonzero((self.ids[v] != own[q]) & (far <= reach[q]))
        q, v, far, meets = q[keep], v[keep], far[keep], meets[keep]
        order = np.lexsort((v, far, q))  # rows of a block lie in the order of their ids
        q, v, far, meets = q[order], v[order], far[order], meets[order]
        starts = q.searchsorted(np.arange(len(turn) + 1))
        active, lacking, out = np.ones(len(turn), bool), np.zeros(len(turn), bool), []
        while active.any():
            verified = active[q] & (meets <= half[q])
            seen = np.r_[0, np.cumsum(verified)]
            rank = seen[1:] - seen[starts[q]]
            last = np.full(len(turn), np.inf)
            kth = verified & (rank == wanted[q])
            last[q[kth]] = far[kth]
            done = active & ((last <= ratio * half) | (np.isinf(half) & np.isinf(reach)))
            best = done[q] & verified & (rank <= wanted[q])
            out.append((turn[q[best]], v[best], far[best]))
            short = seen[starts[1:]] - seen[starts[:-1]] < wanted
            lacking |= active & ~done & short & (reach < ratio * half)
            active &= ~(done | lacking)
            half = half * widen
        bounds[0, turn] = self._renewed(bound, starts, far**2, some)
        bounds[1, turn] = self._renewed(bounds[0, turn], starts, far**2, self.k)
        return [np.concatenate(x) for x in zip(*out)], turn[lacking]


def dealing(rows: DataFrame, block_rows: int, held_queries: int) -> DataFrame:
    """One row per vector length with queries: its numbers of blocks, shards of blocks and chunks of queries.

    A task takes one shard and one chunk; it holds the chunk and reads the shard block by block. A
    vector is sent to every chunk, a query to every shard, so there are only as many of both as
    fill the cores (while a task compares 2e8 pairs at least) or keep a task below 1e11 pairs.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    held = F.ceil(F.col("asked") / held_queries)
    pairs = F.col("rows").cast("double") * F.col("asked")
    tasks = F.greatest(F.ceil(pairs / 1e11), F.least(F.ceil(pairs / 2e8), F.lit(4 * cores)))
    even = F.ceil(F.sqrt(F.col("tasks") * F.col("rows") / F.col("asked")))
    return settle(
        rows.where(F.col("asked") > 0)
        .withColumn("blocks", F.ceil(F.col("rows") / block_rows))
        .withColumn("tasks", tasks)
        .withColumn("shards", F.least("blocks", "tasks", even))
        .withColumn("chunks", F.greatest(held, F.ceil(F.col("tasks") / F.col("shards"))))
        .select("size", *(F.col(c).cast("long").alias(c) for c in ("blocks", "shards", "chunks")))
    )


def dealt(good: DataFrame, plan: DataFrame, every: int) -> DataFrame:
    """``good`` copied to the groups that compare it: as vectors of a block, and as queries."""
    placed = good.join(few_rows(plan), "size").withColumn(
        "salt", F.pmod(F.xxhash64("id", F.col("vec").cast("array<double>")), F.lit(1 << 40))
    )
    zero, block = F.lit(0).cast("long"), F.col("salt") % F.col("blocks")

    def group(shard, chunk):
        return shard * F.col("chunks") + chunk

    as_vector = F.transform(
        F.sequence(zero, F.col("chunks") - 1),
        lambda c: F.struct(group(block % F.col("shards"), c).alias("group"), F.lit(False).alias("query")),
    )
    as_query = F.transform(
        F.sequence(zero, F.col("shards") - 1),
        lambda s: F.struct(group(s, F.col("salt") % F.col("chunks")).alias("group"), F.lit(True).alias("query")),
    )
    to = F.when(F.col("id") % every == 0, F.concat(as_vector, as_query)).otherwise(as_vector)
    return placed.select("size", "id", "vec", block.alias("block"), F.explode(to).alias("to")).select(
        "size", "to.group", "to.query", "block", "id", "vec"
    )


def _searcher(k, projections, share, opening, widen, ratio, query_rows, seed):
    """The search over batches sorted by length and group, queries first, then block by block.

    A task holds the queries of one group, the k best found for each and one block.
    """

    def search(batches):
        import numpy as np
        import pyarrow as pa

        need = math.ceil(share * projections)
        names, points, waiting = np.empty(0, np.int64), None, []

        def compared(block_of):
            """Merge the best of one block into the best so far."""
            size = points.shape[1]
            lines = np.random.default_rng(seed).standard_normal((size, projections))
            block = _Block(
                np.concatenate([x for x, _ in block_of]), np.concatenate([x for _, x in block_of]),
                lines, k, opening, float(np.abs(points).max()),
            )
            for at in range(0, len(names), query_rows):
                part = slice(at, at + query_rows)
                q, v, far = block.search(
                    names[part], points[part].astype(np.float64), bounds[:, part], best[part, k - 1], need, ratio, widen
                )
                order = np.lexsort((v, far, q))
                place = np.arange(len(q)) - q[order].searchsorted(q[order])
                order, place = order[place < k], place[place < k]
                better, q = np.unique(q[order], return_inverse=True)
                score, ids = np.full((len(better), 2 * k), np.nan), np.zeros((len(better), 2 * k), np.int64)
                score[:, :k], ids[:, :k] = best[at + better], best_ids[at + better]
                score[q, k + place], ids[q, k + place] = far[order], block.ids[v[order]]
                first = np.lexsort((ids, score), axis=-1)[:, :k]
                best[at + better] = np.take_along_axis(score, first, axis=1)
                best_ids[at + better] = np.take_along_axis(ids, first, axis=1)

        def results():
            for at in range(0, len(names), 4096):
                part = slice(at, at + 4096)
                q, place = np.nonzero(~np.isnan(best[part]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[part][q]), pa.array(best_ids[part][q, place]), pa.array(best[part][q, place])],
                    names=["query_id", "vec_id", "score"],
                )

        group = turn = None
        for batch in batches:
            size, to, query, block_id, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            same = (size[1:] == size[:-1]) & (to[1:] == to[:-1]) & (query[1:] == query[:-1])
            same &= query[1:] | (block_id[1:] == block_id[:-1])
            cuts = np.r_[0, np.flatnonzero(~same) + 1, len(ids)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                now = (size[a], to[a], query[a], -1 if query[a] else block_id[a])
                if now != turn and waiting:
                    if turn[2]:
                        names = np.concatenate([x for x, _ in waiting])
                        points = np.concatenate([x for _, x in waiting])
                        bounds = np.full((2, len(names)), np.nan)
                        best, best_ids = np.full((len(names), k), np.nan), np.zeros((len(names), k), np.int64)
                    elif len(names):
                        compared(waiting)
                    waiting = []
                if now[:2] != group:
                    if len(names):
                        yield from results()
                    names, group = np.empty(0, np.int64), now[:2]
                turn = now
                vectors = batch.column(5).slice(a, b - a).flatten().to_numpy(zero_copy_only=False)
                waiting.append((ids[a:b], vectors.reshape(b - a, size[a])))
        if waiting and not turn[2] and len(names):
            compared(waiting)
        if len(names):
            yield from results()

    return search


def nearest(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    every: int = 100,
    k: int = 10,
    projections: int = 64,
    share: float = 0.58,
    opening: float = 0.4,
    widen: float = 1.2,
    ratio: float = 1.1,
    block_rows: int = 16384,
    query_rows: int = 2048,
    seed: int = 7,
    held_queries: int = 262144,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found for every row whose id divides by ``every``.

    Vectors are dealt by id hash into blocks of about ``block_rows``, blocks into shards and the
    queries into chunks of at most about ``held_queries``. A task holds one chunk and the k best
    found for each of its queries, reads the blocks of one shard one after another and compares
    ``query_rows`` queries with a block at a time; the k best of all shards are merged by
    distance, then id. How many shards and chunks there are does not change the rows. No vector
    is left out of the index, no window has a cap, and copies of one vector all collide.

    Null ids, null or zero vectors and vectors with null or non-finite components take no
    part; a vector of another length than the query's is no candidate of it (lengths are
    searched apart); repeated ids are rows of their own, except that a query never finds its
    own id; a repeated query id is asked once per distinct vector and its results are ranked
    together. Empty tables give empty results; other columns are not read.
    """
    good = usable(vectors, key, vector).withColumn("size", F.size("vec"))
    rows = good.groupBy("size").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("id") % every == 0).alias("asked")
    )
    plan = dealing(rows, block_rows, held_queries)
    groups = F.col("shards") * F.col("chunks")
    total, most = plan.agg(F.coalesce(F.sum(groups), F.lit(1)), F.coalesce(F.max(groups), F.lit(1))).first()
    tasks = min(total, max(most, shuffle_width(vectors.sparkSession)))
    found = (
        dealt(good, plan, every)
        .repartitionById(tasks, F.pmod(F.xxhash64("size") + F.col("group"), F.lit(tasks)).cast("int"))
        .sortWithinPartitions("size", "group", F.desc("query"), "block")
        .mapInArrow(
            _searcher(k, projections, share, opening, widen, ratio, query_rows, seed),
            "query_id long, vec_id long, score double",
        )
    )
    ranks = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(ranks))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


@query()
def op10_collision_counting(spark, sf_dir):
    """The 10 nearest found for every 100th vector, by Euclidean distance."""
    return nearest(table(spark, sf_dir, "embeddings"))
