"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

1. Document frequencies of hashed shingles, summed over all documents into a table of fixed
   size; a shingle weighs its count in the text times its smoothed idf.
2. Every text gets consistent weighted samples: two texts agree on one with a probability
   equal to their weighted Jaccard similarity. Four samples make a band, and each sample is
   in two bands; texts that share a band are candidates. A band's key is refined once with
   further samples. The same draws with equal weights give plain samples and their bands,
   for pairs that only their sets of shingles link.
3. Within the texts of one key, each is first paired with the smallest text of the key and
   of its refined key, which joins crowds of copies by n - 1 pairs. The texts of keys that
   then still hold several classes are sorted by class and cut into blocks of bounded size.
   Every two blocks of a key that hold several classes between them are compared whole; only
   the links that join two classes leave them: fewer than their texts. A part of the keys is
   taken first and with fewer comparisons, which joins most classes; then all keys that still
   hold several are taken, with all comparisons.
4. Pairs are verified on the whole texts and links are closed to classes.

Equal texts are one text from the start, however often they occur.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmatch.llm.common import fresh, publish, query, quoted, table, whole
from pairmatch.llm.words import BLANK, chunks, mix, word_hashes
from pairmatch.operators.graph import component_roots
from pairmatch.operators.ranking import running_sums
from pairmatch.session import settle, shuffle_width


@dataclass(frozen=True)
class Plan:
    """Parameters. The samples are cut into bands twice, as rows and as columns: a pair of
    similarity 0.8 shares no row with probability 0.0018, and of those few most share a column."""

    words: int = 5
    similarity: float = 0.8
    samples: int = 48
    rows: int = 4
    #: Samples that the refinement of a band's key adds.
    finer: int = 3
    #: Pairs of an unresolved key are verified if their samples agree this often: at similarity
    #: 0.8 a pair of 48 samples stays below it with a probability of 0.00001.
    agree: int = 26
    #: Texts of a block of an unresolved key, and their characters; two blocks are compared at once.
    block: int = 512
    block_chars: int = 1 << 22
    #: Texts of the largest class there that each text outside of it is compared with, at first.
    nearest: int = 3
    #: One in so many unresolved keys is taken first; all keys then start from the classes it gives.
    ahead: int = 4
    #: Whether a pair is also linked by its sets of shingles alone.
    plain: bool = True
    #: Document frequencies are counted for this many hashed features.
    features: int = 1 << 16
    #: Frequencies below this share of the documents count as this share: only passages that
    #: many documents carry weigh less than other text.
    floor: float = 0.05
    seed: int = 3


def shingles(texts: list[str], words: int):
    """For each text its distinct shingle hashes, ascending, and their counts.

    A text of fewer words than a shingle has one shingle, all of its words; a text without
    words has none.
    """
    import numpy as np

    raw = [t.encode() for t in texts]
    out = []
    for first, last in chunks([len(t) for t in raw]):
        counts, (hashes,) = word_hashes(raw[first:last], BLANK)
        for a, b in zip(counts, counts[1:]):
            own = hashes[a:b]
            if not len(own):
                out.append((own, np.empty(0, np.int64)))
                continue
            width = min(words, len(own))
            run = own[: len(own) - width + 1]
            for j in range(1, width):
                run = mix(run + own[j : len(own) - width + 1 + j] * np.uint64(2 * j + 1))
            out.append(np.unique(run, return_counts=True))
    return out


def feature_counts(docs: DataFrame, text: str, plan: Plan) -> tuple[int, dict[int, int]]:
    """Number of documents, and the document frequency of the features over the floor.

    Every task adds up its own documents first, so it hands on one number per feature; at
    most (shingles per text / floor) features can lie over the floor.
    """

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        total, rows = np.zeros(plan.features, np.int64), 0
        for batch in batches:
            texts = [v or "" for v in batch.column(0).to_pylist()]
            rows += len(texts)
            for first, last in chunks([len(t) for t in texts]):
                for own, _ in shingles(texts[first:last], plan.words):
                    total[np.unique(own % np.uint64(plan.features)).astype(np.int64)] += 1
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(met, -1)), pa.array(np.append(total[met], rows))], names=["feature", "n"]
        )

    counted = settle(
        docs.select(quoted(text))
        .mapInArrow(count, "feature long, n long")
        .groupBy("feature")
        .agg(F.sum("n").alias("n"))
    )
    rows = counted.where("feature = -1").select("n").first()
    size = rows["n"] if rows else 0
    often = counted.where((F.col("feature") >= 0) & (F.col("n") > plan.floor * size)).collect()
    return size, {r["feature"]: r["n"] for r in often}


class Sampler:
    """Consistent weighted samples with parameters drawn from a fixed table by shingle hash.

    For a shingle of weight w a sample draws r and c from Gamma(2, 1) and b from (0, 1), all by
    hash, sets t = floor(ln w / r + b), and keeps the shingle with the smallest
    ln a = ln c - r (t - b + 1), with its t. Equal hashes and weights give equal draws anywhere.
    Most shingles occur once in their text and are rare, so they share one weight, for which
    the draws are worked out once per table entry.
    """

    def __init__(self, plan: Plan, documents: int, often: dict[int, int]):
        import numpy as np

        self.plan = plan
        rng = np.random.default_rng(plan.seed)
        size = 1 << 16
        self.r, c = rng.gamma(2.0, 1.0, size), rng.gamma(2.0, 1.0, size)
        self.b = rng.random(size)
        self.base = np.log(c) + self.r * (self.b - 1)
        self.turns = (rng.integers(1, 1 << 31, plan.samples) * 2 + 1).astype(np.uint32)
        rare = max(plan.floor * documents, 1.0)
        self.common = math.log((1 + documents) / (1 + rare)) + 1
        self.idf = np.full(plan.features, self.common)
        for feature, n in often.items():
            self.idf[feature] = math.log((1 + documents) / (1 + n)) + 1
        step = np.floor(math.log(self.common) / self.r + self.b)
        self.step, self.value = step.astype(np.int64), (self.base - self.r * step).astype(np.float32)

    def weights(self, hashes, counts):
        import numpy as np

        return counts * self.idf[(hashes % np.uint64(self.plan.features)).astype(np.int64)]

    def _spots(self, hashes):
        """Table entry of every (sample, shingle)."""
        import numpy as np

        spots = (hashes >> np.uint64(32)).astype(np.uint32)[None, :] * self.turns[:, None]
        spots >>= np.uint32(16)
        return spots

    def samples(self, hashes, counts):
        """One 64-bit value per sample."""
        return self.both_samples(hashes, counts)[0]

    def both_samples(self, hashes, counts):
        """The weighted samples, and those of the set of shingles: all at the common weight."""
        import numpy as np

        lines = np.arange(len(self.turns))
        best, plain_best = (np.full(len(lines), np.inf, np.float32) for _ in range(2))
        out, plain_out, plain_hash = (np.zeros(len(lines), np.uint64) for _ in range(3))
        weights = self.weights(hashes, counts)
        plain = weights == self.common
        for usual in (True, False):
            own = np.flatnonzero(plain == usual)
            for first in range(0, len(own), 4096):
                part = hashes[own[first : first + 4096]]
                spots = self._spots(part)
                value = self.value.take(spots)
                at = value.argmin(axis=1)
                low, chosen = value[lines, at], part[at]
                drawn = self._drawn(chosen, self.step[spots[lines, at]])
                # Both halves' hashes ascend, so of equal values the smaller hash is kept.
                if self.plan.plain:
                    less = (low < plain_best) | ((low == plain_best) & (chosen < plain_hash))
                    plain_best[less], plain_hash[less], plain_out[less] = low[less], chosen[less], drawn[less]
                if not usual:
                    logs = np.log(weights[own[first : first + 4096]])
                    r = self.r.take(spots)
                    step = np.floor(logs / r + self.b.take(spots))
                    value = (self.base.take(spots) - r * step).astype(np.float32)
                    at = value.argmin(axis=1)
                    low, drawn = value[lines, at], self._drawn(part[at], step[lines, at].astype(np.int64))
                less = low < best
                best[less], out[less] = low[less], drawn[less]
        return out, plain_out

    @staticmethod
    def _drawn(chosen, steps):
        import numpy as np

        return mix(chosen ^ steps.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def keys(self, samples):
        """The keys of every band for rows of samples: the bands' own, then the refined ones."""
        import numpy as np

        plan = self.plan
        count = plan.samples // plan.rows
        band = np.arange(2 * count)
        # Rows take neighbouring samples, columns every count-th one; both read on in a ring.
        step = np.where(band < count, 1, count)
        first = np.where(band < count, band * plan.rows, band - count)
        key = np.broadcast_to((band + 1).astype(np.uint64), (len(samples), 2 * count))
        out = []
        for j in range(plan.rows + plan.finer):
            lap = np.where(step > 1, j // plan.rows, 0)
            key = mix(key * np.uint64(3) + samples[:, (first + j * step + lap) % plan.samples])
            if j + 1 in (plan.rows, plan.rows + plan.finer):
                out.append(mix(key + np.uint64(j)).astype(np.int64))
        return out


def signatures(docs: DataFrame, key: str, text: str, plan: Plan, documents: int, often: dict[int, int]) -> DataFrame:
    """``uid, id, text_key, bands, finer, signs, chars`` of every row: a row number of its own, the
    document's key, a 128-bit digest of its text, the bands' keys and their refinements (none
    for a text without words; plain ones where they differ from the weighted), 16 bits of each
    sample, weighted ones first, and the text's length. Published, since the row numbers must
    not be dealt twice."""

    def sign(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        sampler = Sampler(plan, documents, often)
        none = np.zeros(plan.samples, np.uint64)
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = [v or "" for v in batch.column(2).to_pylist()]
            rows, plain, empty = [], [], []
            for first, last in chunks([len(t) for t in texts]):
                for hashes, counts in shingles(texts[first:last], plan.words):
                    empty.append(not len(hashes))
                    both = sampler.both_samples(hashes, counts) if len(hashes) else (none, none)
                    rows.append(both[0])
                    plain.append(both[1])
            if not rows:
                continue
            own = sampler.keys(np.stack(rows))
            others = sampler.keys(np.stack(plain)) if plan.plain else [k[:, :0] for k in own]
            # A refined key holds its band's samples, so where it is the same both are.
            further = own[1] != others[1] if plan.plain else np.zeros((len(rows), 0), bool)
            full = np.concatenate([np.ones(own[1].shape, bool), further], axis=1)
            full &= ~np.array(empty, bool)[:, None]
            ends = np.cumsum([0, *full.sum(axis=1)])
            columns = [
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(k, axis=1)[full]))
                for k in zip(own, others)
            ]
            signs = np.concatenate([np.stack(rows), np.stack(plain)][: 1 + plan.plain], axis=1).astype(np.uint16)
            columns.append(pa.array([line.tobytes() for line in signs], pa.binary()))
            numbers = pa.array(np.arange(uid, uid + len(texts), dtype=np.int64))
            uid += len(texts)
            yield pa.RecordBatch.from_arrays(
                [numbers, batch.column(0), batch.column(1), *columns, pa.array([len(t) for t in texts], pa.int64())],
                names=["uid", "id", "text_key", "bands", "finer", "signs", "chars"],
            )

    rows = docs.select(
        quoted(key).cast("long").alias("id"),
        F.md5(whole(quoted(text)).cast("binary")).alias("text_key"),
        quoted(text).alias("text"),
    )
    schema = "uid long, id long, text_key string, bands array<long>, finer array<long>, signs binary, chars long"
    return publish(rows.mapInArrow(sign, schema))


def candidate_pairs(texts: DataFrame) -> DataFrame:
    """Distinct ``id1 > id2``: every text of a key with the key's smallest one.

    ``texts(uid, bands, finer)``. A crowded key is one minimum, combined map-side, and one row
    per text in the join, which adaptive execution splits. Only texts in company go on to the
    refined keys.
    """

    def paired(rows: DataFrame) -> DataFrame:
        heads = rows.groupBy("band").agg(F.min("uid").alias("id2"))
        return rows.join(heads, "band")

    rows = texts.select("uid", F.inline(F.arrays_zip(F.col("bands").alias("band"), F.col("finer").alias("fine"))))
    first = settle(paired(rows).where("uid > id2").select("uid", "id2", "fine"))
    # The smallest text of a key has met all others of it; it needs no refined key.
    second = paired(first.select("uid", F.col("fine").alias("band"))).where("uid > id2")
    return first.select("uid", "id2").unionByName(second.select("uid", "id2")).toDF("id1", "id2").distinct()


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots.select(F.col("id").alias("uid"), "root"), "uid", "left").withColumn(
        "root", F.coalesce("root", "uid")
    )


def unresolved(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows with ``band, uid`` of the keys whose texts are not all in one class, with their ``root``.

    ``roots(id, root)`` of the linked texts.
    """
    rooted = _rooted(rows, roots)
    ends = rooted.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("b"))
    return rooted.join(ends.where("a < b").select("band"), "band")


def joined_roots(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots(id, root)`` after ``links(id1, id2)``: the components of the few classes they touch."""
    known = roots.select(F.col("id").alias("uid"), "root")
    ends = links
    for end in ("id1", "id2"):
        own = known.toDF(end, "own")
        ends = ends.join(own, end, "left").withColumn(end, F.coalesce("own", end)).drop("own")
    further = settle(component_roots(ends))
    # Texts that had no class yet were classes of their own.
    every = roots.unionByName(further.select("id", F.col("id").alias("root"))).distinct()
    moved = every.join(further.toDF("root", "to"), "root", "left")
    return moved.select("id", F.coalesce("to", "root").alias("root"))


def _units(batches: Iterator, kinds: int) -> Iterator:
    """The rows of each (band, left, right) of sorted batches, as lists of ``kinds`` further columns."""
    rows, now = None, None
    for batch in batches:
        for band, left, right, *rest in zip(*(c.to_pylist() for c in batch.columns)):
            if (band, left, right) != now:
                if rows is not None:
                    yield now, rows
                rows, now = [[] for _ in range(kinds)], (band, left, right)
            for column, value in zip(rows, rest):
                column.append(value)
    if rows is not None:
        yield now, rows


def _dealt(rows: DataFrame) -> DataFrame:
    """Whole pairs of blocks, side by side. They are work, not bytes: small ones must not be put into few tasks."""
    unit = ("band", "left", "right")
    return rows.repartition(shuffle_width(rows.sparkSession), *unit).sortWithinPartitions(*unit)


def dealt_blocks(rows: DataFrame, texts: DataFrame, plan: Plan) -> DataFrame:
    """``band, left, right, block, uid, root, signs``: every key's texts in all pairs of its blocks.

    A key's texts are ordered by class and cut into blocks where ``plan.block`` texts or
    ``plan.block_chars`` characters are full. Two blocks ``left <= right`` are a unit of work,
    handed out with the texts of both; so is every block with itself. Two texts of a key that
    are in different classes thus meet in exactly one unit. Units that hold one class alone
    are left out, so a crowd that is one class but for a few texts stays in proportion to its
    size; only texts of many classes under one key cost all pairs of their blocks. The order is
    one range shuffle over all keys, so a key of any size spreads over the tasks.
    """
    signed = rows.join(texts.select("uid", "signs", "chars"), "uid").select(
        "band",
        "uid",
        "root",
        "signs",
        F.greatest(F.col("chars"), F.lit(-(-plan.block_chars // plan.block))).alias("weight"),
    )
    ran = running_sums(signed, ["band"], F.struct("root", "uid"), ["weight"], totals=False)
    block = F.floor((F.col("weight_upto") - F.col("weight")) / F.lit(plan.block_chars)).cast("long")
    cut = ran.select("band", block.alias("block"), "uid", "root", "signs")
    ends = cut.groupBy("band", "block").agg(F.min("root").alias("least"), F.max("root").alias("most"))
    left = ends.select("band", F.col("block").alias("left"), F.col("least").alias("a"), F.col("most").alias("b"))
    right = ends.select("band", F.col("block").alias("right"), F.col("least").alias("c"), F.col("most").alias("d"))
    units = left.join(right, "band").where(
        (F.col("left") <= F.col("right")) & (F.least("a", "c") < F.greatest("b", "d"))
    )
    places = units.select(
        "band", "left", "right", F.explode(F.array_distinct(F.array("left", "right"))).alias("block")
    )
    return cut.join(places, ["band", "block"]).select("band", "left", "right", "block", "uid", "root", "signs")


def agreeing(dealt: DataFrame, plan: Plan, nearest: int | None = None) -> DataFrame:
    """``band, left, right, block, uid, root`` of the texts that agree with one of another class in their unit.

    Two texts agree if ``plan.agree`` of their samples do; those of two blocks meet across them.
    With ``nearest``, of the unit's largest class only so many that agree most with a text
    outside of it are handed on.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for (band, left, right), (block, uid, root, signs) in _units(batches, 4):
            root, block = np.array(root), np.array(block)
            if (root == root[0]).all():
                continue
            signs = np.frombuffer(b"".join(signs), np.uint16).reshape(len(uid), -1)
            _, number, sizes = np.unique(root, return_inverse=True, return_counts=True)
            inside = number == sizes.argmax()
            others, largest = np.flatnonzero(~inside), np.flatnonzero(inside)
            met = np.zeros(len(uid), bool)
            for first in range(0, len(others), 256):
                part = others[first : first + 256]
                most = np.zeros((len(part), len(uid)), np.uint8)
                for half in range(0, signs.shape[1], plan.samples):
                    same = np.zeros_like(most)
                    for j in range(half, half + plan.samples):
                        same += signs[part, j][:, None] == signs[:, j]
                    most = np.maximum(most, same)
                most[(most < plan.agree) | (root[part][:, None] == root)] = 0
                if left < right:
                    most[block[part][:, None] == block] = 0
                met[part] |= most.any(axis=1)
                near = most[:, largest]
                if nearest is None:
                    met |= most.any(axis=0)
                else:
                    at = np.argpartition(-near.astype(np.int16), min(nearest, near.shape[1]) - 1, axis=1)[:, :nearest]
                    met[largest[at[np.take_along_axis(near, at, axis=1) > 0]]] = True
            own = np.flatnonzero(met)
            if len(own):
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array(np.full(len(own), x)) for x in (band, left, right)),
                        pa.array(block[own]),
                        pa.array(np.array(uid)[own]),
                        pa.array(root[own]),
                    ],
                    names=["band", "left", "right", "block", "uid", "root"],
                )

    rows = _dealt(dealt)
    return rows.select("band", "left", "right", "block", "uid", "root", "signs").mapInArrow(
        run, "band long, left long, right long, block long, uid long, root long"
    )


#: Texts that share a feature, up to which its pairs are listed.
FEW = 16


def similarities(own, weights):
    """Similarity of all pairs of texts, each given as its distinct shingles and their counts.

    Weighted by ``weights`` (a function of shingles and counts); every occurrence of a shingle
    is a feature of its own, so the sum of the smaller weights is a product of two matrices,
    added up over slices of the features that two texts share; features of few texts are added
    pair by pair.
    """
    import numpy as np

    totals = np.array([weights(h, c).sum() for h, c in own])
    sizes = [int(c.sum()) for _, c in own]
    text = np.repeat(np.arange(len(own)), sizes)
    hashes = np.concatenate([np.repeat(h, c) for h, c in own])
    each = np.concatenate([np.repeat(weights(h, np.ones_like(c)), c) for h, c in own])
    # The running number of a shingle's occurrence inside its text.
    turn = np.concatenate([np.arange(n) - np.repeat(np.cumsum(c) - c, c) for n, (_, c) in zip(sizes, own)])
    feature = mix(hashes + turn.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, place, met = np.unique(feature, return_inverse=True, return_counts=True)
    shared = met[place] > 1
    order = np.argsort(place[shared], kind="stable")
    text, place, each = text[shared][order], place[shared][order], each[shared][order]
    both = np.zeros((len(own), len(own)), np.float32)
    first = np.flatnonzero(np.diff(place, prepend=-1)) if len(place) else place
    carriers = np.diff(np.append(first, len(place)))
    # A feature of few texts gives its pairs one by one.
    for count in range(2, FEW + 1):
        starts = first[carriers == count]
        if not len(starts):
            continue
        left, right = np.triu_indices(count, 1)
        at = (text[starts[:, None] + left] * len(own) + text[starts[:, None] + right]).ravel()
        each_pair = np.repeat(each[starts], len(left))
        both += np.bincount(at, each_pair, len(own) ** 2).reshape(both.shape).astype(np.float32)
    both += both.T
    # The others are columns of a matrix, taken in slices.
    many = carriers > FEW
    column = np.repeat(np.cumsum(many) - 1, carriers)
    kept = np.repeat(many, carriers)
    text, column, each = text[kept], column[kept], each[kept]
    width = max(256, (1 << 22) // max(1, len(own)))
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [start, start + width])
        part = np.zeros((len(own), width), np.float32)
        part[text[a:b], column[a:b] - start] = np.sqrt(each[a:b])
        both += part @ part.T
    return both / np.maximum(totals[:, None] + totals - both, 1e-9)


def joining(near, root):
    """Pairs (i, j) of ``near``, a symmetric matrix of links, that join the classes ``root``: a tree."""
    import numpy as np

    out, open_ = [], np.ones(len(root), bool)
    while open_.any():
        front = np.flatnonzero(root == root[np.flatnonzero(open_)[0]])
        open_[front] = False
        while len(front):
            reached = np.flatnonzero(near[front].any(axis=0) & open_)
            if not len(reached):
                break
            # One link for every class that is reached.
            _, first = np.unique(root[reached], return_index=True)
            for j in reached[first]:
                out.append((int(front[near[front, j].argmax()]), int(j)))
            front = np.flatnonzero(np.isin(root, root[reached]))
            open_[front] = False
    return out


def block_links(members: DataFrame, plan: Plan, documents: int, often: dict[int, int]) -> DataFrame:
    """``id1, id2`` of verified pairs that join two classes of a unit: fewer than its texts.

    ``members(band, left, right, block, uid, root, text)``.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        sampler = Sampler(plan, documents, often)
        kinds = [sampler.weights, lambda h, c: c.astype(np.float64)][: 1 + plan.plain]

        def exact(weights, left, right):
            (a, n), (b, m) = left, right
            x, y = weights(a, n), weights(b, m)
            _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
            both = np.minimum(x[i], y[j]).sum()
            return both / (x.sum() + y.sum() - both)

        for (_, left, right), (block, uid, root, text) in _units(batches, 4):
            own = shingles([t or "" for t in text], plan.words)
            root, block = np.array(root), np.array(block)
            apart = root[:, None] != root
            if left < right:
                apart &= block[:, None] != block
            near = np.zeros((len(own), len(own)), bool)
            for kind, weights in enumerate(kinds):
                # The plain similarity is that of sets: each shingle once.
                taken = own if kind == 0 else [(h, np.ones_like(c)) for h, c in own]
                found = similarities(taken, weights)
                found[~apart] = 0
                near |= found >= plan.similarity
                # Single precision may err in the last digits: pairs at the threshold are counted anew.
                for i, j in zip(*np.nonzero(np.triu(np.abs(found - plan.similarity) < 1e-4))):
                    near[i, j] = near[j, i] = exact(weights, taken[i], taken[j]) >= plan.similarity or (
                        kind > 0 and near[i, j]
                    )
            pairs = [(uid[i], uid[j]) for i, j in joining(near, root)]
            if pairs:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([max(p) for p in pairs]), pa.array([min(p) for p in pairs])], names=["id1", "id2"]
                )

    rows = _dealt(members)
    return (
        rows.select("band", "left", "right", "block", "uid", "root", "text")
        .mapInArrow(run, "id1 long, id2 long")
        .distinct()
    )


def verify(pairs: DataFrame, plan: Plan, documents: int, often: dict[int, int]) -> DataFrame:
    """``id1, id2, weighted, plain``: the similarities of every pair of whole texts.

    ``weighted`` is the sum of the smaller TF-IDF weights over the sum of the larger ones,
    ``plain`` the Jaccard similarity of the sets of shingles.
    """

    def compare(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        sampler = Sampler(plan, documents, often)

        def similar(left, right):
            (a, n), (b, m) = left, right
            if not len(a) or not len(b):
                return 0.0, 0.0
            x, y = sampler.weights(a, n), sampler.weights(b, m)
            _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
            both = np.minimum(x[i], y[j]).sum()
            return float(both / (x.sum() + y.sum() - both)), len(i) / (len(a) + len(b) - len(i))

        seen_id, seen = None, None
        for batch in batches:
            id1, id2 = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            got = []
            for first in range(0, batch.num_rows, 128):
                left = shingles([v or "" for v in batch.column(2).slice(first, 128).to_pylist()], plan.words)
                for place, own in enumerate(left, first):
                    # Rows come sorted by the second text, so it is cut into shingles once.
                    if id2[place] != seen_id:
                        seen_id = id2[place]
                        seen = shingles([batch.column(3)[place].as_py() or ""], plan.words)[0]
                    got.append(similar(own, seen))
            weighted, plain = zip(*got) if got else ((), ())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(id1, pa.int64()),
                    pa.array(id2, pa.int64()),
                    pa.array(weighted, pa.float64()),
                    pa.array(plain, pa.float64()),
                ],
                names=["id1", "id2", "weighted", "plain"],
            )

    return pairs.select("id1", "id2", "text1", "text2").mapInArrow(
        compare, "id1 long, id2 long, weighted double, plain double"
    )


def _texts(docs: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """``uid, text`` of the wanted ``(uid, id, text_key)``; only their texts pass the join."""
    rows = docs.select(
        quoted(key).cast("long").alias("id"),
        F.md5(whole(quoted(text)).cast("binary")).alias("text_key"),
        quoted(text).alias("text"),
    )
    met = (F.col("t.text_key") == F.col("w.text_key")) & F.col("t.id").eqNullSafe(F.col("w.id"))
    # Rows equal in key and text are one text.
    return publish(rows.alias("t").join(wanted.alias("w"), met).select("w.uid", "t.text").dropDuplicates(["uid"]))


def _links(pairs: DataFrame, texts: DataFrame, plan: Plan, documents: int, often: dict[int, int]) -> DataFrame:
    """``id1, id2`` of the pairs that are near duplicates by their whole texts."""
    with_texts = pairs.join(texts.select(F.col("uid").alias("id1"), F.col("text").alias("text1")), "id1").join(
        texts.select(F.col("uid").alias("id2"), F.col("text").alias("text2")), "id2"
    )
    near = F.col("weighted") >= plan.similarity
    if plan.plain:
        near = near | (F.col("plain") >= plan.similarity)
    return settle(verify(with_texts, plan, documents, often).where(near).select("id1", "id2"))


def classes(docs: DataFrame, key: str, text: str, plan: Plan = Plan()) -> DataFrame:
    """``uid, id, text_key, text_class, class, class_id, class_rows, kept`` of every row.

    ``class`` numbers the group of near duplicates, ``class_id`` is its smallest document key,
    ``kept`` marks one row of each class: the one with that key (several: the first numbered).
    A pair is linked if its weighted similarity reaches ``plan.similarity``; with ``plan.plain``
    also if that of its sets of shingles does. Links are closed transitively. Equal texts, empty ones included, are in one class; null texts are read as
    empty; texts without words link to nothing but their copies; null keys are documents like
    others and come last in the choice; rows with equal keys stay rows of their own; empty
    tables give no rows; other columns are not read.
    """
    documents, often = feature_counts(docs, text, plan)
    signed = signatures(docs, key, text, plan, documents, often)
    heads = signed.groupBy("text_key").agg(F.min("uid").alias("text_class"))
    members = settle(signed.select("uid", "id", "text_key").join(heads, "text_key"))
    firsts = members.where("uid = text_class").select("uid", "id", "text_key")
    alone = signed.join(firsts.select("uid"), "uid", "left_semi")
    pairs = settle(candidate_pairs(alone.select("uid", "bands", "finer")))
    involved = pairs.select(F.col("id1").alias("uid")).unionByName(pairs.select(F.col("id2").alias("uid"))).distinct()
    # Every text of a key with company is in a pair, so these are all texts that are ever compared.
    texts = _texts(docs, key, text, firsts.join(involved, "uid"))
    links = _links(pairs, texts, plan, documents, often)
    roots = settle(component_roots(links))
    keyed = alone.select("uid", F.posexplode(F.array_distinct("bands")).alias("part", "band"))
    later = F.col("part") % plan.ahead != 0
    mixed = publish(unresolved(keyed.withColumn("later", later), roots).drop("root", "part"))
    # Some of the keys with the nearest texts only, then all keys that are left, with all their pairs.
    for rows, nearest in ((mixed.where(~F.col("later")), plan.nearest), (mixed, None)):
        left = unresolved(rows.drop("later"), roots)
        crowds = publish(agreeing(dealt_blocks(left, alone, plan), plan, nearest))
        if crowds.isEmpty():
            continue
        more = settle(block_links(crowds.join(texts, "uid"), plan, documents, often))
        if not more.isEmpty():
            roots = settle(joined_roots(roots, more))
    classed = members.join(
        roots.select(F.col("id").alias("text_class"), F.col("root")), "text_class", "left"
    ).withColumn("class", F.coalesce("root", "text_class"))
    classed = settle(classed.select("uid", "id", "text_key", "text_class", "class"))
    chosen = classed.groupBy("class").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid")).alias("first"),
        F.count(F.lit(1)).alias("class_rows"),
    )
    return classed.join(chosen, "class").select(
        "uid",
        "id",
        "text_key",
        "text_class",
        "class",
        F.col("first.id").alias("class_id"),
        "class_rows",
        (F.col("uid") == F.col("first.uid")).alias("kept"),
    )


def keep_one(docs: DataFrame, key: str, text: str, plan: Plan = Plan()) -> DataFrame:
    """One document of each class, with all its columns, whatever their names.

    Nulls, empty texts, repeated rows and empty tables are those of ``classes``.
    """
    own, name, digest = (fresh(docs.columns, n) for n in ("_near_text", "_near_id", "_near_key"))
    kept = classes(docs, key, text, plan).where("kept").select(
        F.col("id").alias(name), F.col("text_key").alias(digest)
    )
    met = (F.col(own) == F.col(digest)) & quoted(key).cast("long").eqNullSafe(F.col(name))
    return (
        docs.withColumn(own, F.md5(whole(quoted(text)).cast("binary")))
        .join(kept, met)
        # Rows equal in key and text were one choice; one of them stays.
        .dropDuplicates([digest, name])
        .select(*map(quoted, docs.columns))
    )


@query()
def op8_weighted_minhash(spark, sf_dir):
    """Every document with the class of its near duplicates and the class of its equal texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classes(docs, "doc_id", "text", Plan(plain=False)).select(
        F.col("id").alias("doc_id"), "class_id", "class_rows", "kept", "text_class"
    )
