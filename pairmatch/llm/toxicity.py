"""Toxicity by a small convolutional text classifier, trained in numpy.

A word is the sum of hashed embeddings of itself and of its beginnings (stems with varying
ends share those). Filters over one, two and three words slide over the whole text, each is
pooled to its largest answer anywhere in it, and a logistic layer reads the pooled answers.
Training sees a bounded sample of labelled texts; a part of it is kept aside to calibrate the
score and, per language, the threshold. Scoring reads the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairmatch.llm.common import query, quoted, table, whole
from pairmatch.llm.words import PUNCTUATION, chunks, word_hashes

PREFIXES = (4, 5, 6, 7, 8)
WIDTHS = (1, 2, 3)


@dataclass
class Classifier:
    """Weights of the network; ``slots`` rows per embedding table, the last one for padding."""

    slots: int = 1 << 15
    size: int = 8
    filters: int = 8
    seed: int = 5
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict = field(default_factory=dict)
    default: float = 0.7

    def __post_init__(self):
        import numpy as np

        rng = np.random.default_rng(self.seed)
        tables = 1 + len(PREFIXES)
        self.embedding = (rng.standard_normal((tables, self.slots + 1, self.size)) * 0.02).astype(np.float32)
        self.embedding[:, -1] = 0
        # Columns of the filters: width 1, then both places of width 2, then three of width 3.
        self.kernel = (rng.standard_normal((self.size, sum(WIDTHS) * self.filters)) * 0.5).astype(np.float32)
        self.bias = np.zeros(len(WIDTHS) * self.filters, np.float32)
        self.out = (rng.standard_normal(len(WIDTHS) * self.filters) * 0.3).astype(np.float32)
        self.base = np.float32(0.0)

    def slots_of(self, texts: list[str]):
        """Rows of the embedding tables for every word, with padding after each text, and the
        place where each text begins."""
        import numpy as np

        counts, features = word_hashes([t.lower().encode() for t in texts], PUNCTUATION, PREFIXES)
        pad = max(WIDTHS)
        lengths = np.diff(counts)
        begins = counts[:-1] + pad * np.arange(len(texts))
        ids = np.full((len(features), int(counts[-1]) + pad * len(texts)), self.slots, np.int32)
        at = np.arange(int(counts[-1])) + pad * np.repeat(np.arange(len(texts)), lengths)
        for row, feature in zip(ids, features):
            row[at] = (feature >> np.uint64(17)) % np.uint64(self.slots)
        return ids, begins

    def answers(self, ids):
        """The filters' answers at every place."""
        import numpy as np

        words = self.embedding[0][ids[0]]
        for number in range(1, len(ids)):
            words += self.embedding[number][ids[number]]
        # Added up place by place in a fixed order: a matrix product may round a row differently
        # with other rows beside it, and a score must not depend on its neighbours.
        parts = words[:, :1] * self.kernel[0]
        for d in range(1, self.size):
            parts += words[:, d : d + 1] * self.kernel[d]
        step, out, column = self.filters, np.zeros((len(parts), len(self.bias)), np.float32), 0
        for k, width in enumerate(WIDTHS):
            place = out[:, k * step : (k + 1) * step]
            for j in range(width):
                place[: len(parts) - j] += parts[j:, column : column + step]
                column += step
        return words, out

    def pooled(self, ids, begins):
        import numpy as np

        words, out = self.answers(ids)
        # At a text's last places of padding a wide filter would read the next text's words.
        ends = np.append(begins[1:], len(out))
        for k, width in enumerate(WIDTHS):
            for i in range(1, width):
                out[ends - i, k * self.filters : (k + 1) * self.filters] = -np.inf
        return words, out, np.maximum.reduceat(out, begins, axis=0)

    def logits(self, texts: list[str]):
        import numpy as np

        if not texts:
            return np.empty(0)
        ids, begins = self.slots_of(texts)
        top = np.maximum(self.pooled(ids, begins)[2] + self.bias, 0)
        total = np.full(len(top), float(self.base))
        for answer, weight in zip(top.T.astype(np.float64), self.out.astype(np.float64)):
            total += answer * weight
        return total

    def scores(self, texts: list[str]):
        import numpy as np

        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(texts) + self.shift, -40, 40)))

    def start_from(self, prepared, labels, least: int) -> None:
        """First dimension: the shrunk log-odds of meeting the slot in a text of class 1. Slots met
        in fewer than ``least`` training texts stay silent, or single texts would be learnt by heart."""
        import numpy as np

        for number, rows in enumerate(self.embedding):
            met = np.zeros((2, self.slots + 1))
            for (ids, _), y in zip(prepared, labels):
                met[int(y), np.unique(ids[number])] += 1
            ones, noughts = labels.sum(), (1 - labels).sum()
            odds = np.log((met[1] + 1) / (ones + 2)) - np.log((met[0] + 1) / (noughts + 2))
            # Evidence against the class counts little: a text is toxic by what it holds.
            rows[:, 0] += np.clip(odds - np.log((noughts + 2) / (ones + 2)), -0.5, 4).astype(np.float32)
            rows[met.sum(axis=0) < least] = 0
            rows[-1] = 0
        self.kernel[0] = np.abs(self.kernel[0])
        self.out = np.abs(self.out)

    def train(self, texts: list[str], labels, epochs: int = 6, batch: int = 48, rate: float = 0.01, least: int = 3):
        """Adam on the logistic loss. Only the place that wins the pooling passes a gradient on."""
        import numpy as np

        labels = np.asarray(labels, np.float32)
        prepared = [self.slots_of([t]) for t in texts]
        self.start_from(prepared, labels, least)
        weight = np.where(labels == 1, len(labels) / max(2 * labels.sum(), 1), len(labels) / max(2 * (1 - labels).sum(), 1))
        rng = np.random.default_rng(self.seed)
        params = {"kernel": self.kernel, "bias": self.bias, "out": self.out}
        first = {k: np.zeros_like(v) for k, v in params.items()}
        second = {k: np.zeros_like(v) for k, v in params.items()}
        squared = np.zeros(self.embedding.shape[:2], np.float32)
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), batch):
                chosen = order[at : at + batch]
                ids = np.concatenate([prepared[i][0] for i in chosen], axis=1)
                begins = np.cumsum([0, *(prepared[i][0].shape[1] for i in chosen)])
                words, out, top = self.pooled(ids, begins[:-1])
                hidden = np.maximum(top + self.bias, 0)
                logit = hidden @ self.out + self.base
                error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[chosen]) * weight[chosen] / len(chosen)
                grads = {"out": hidden.T @ error}
                back = np.outer(error, self.out) * (hidden > 0)
                grads["bias"] = back.sum(0)
                kernel_grad, rows, row_grads = np.zeros_like(self.kernel), [], []
                column = 0
                for k, width in enumerate(WIDTHS):
                    for f in range(self.filters):
                        c = k * self.filters + f
                        won = np.array(
                            [a + int(out[a:b, c].argmax()) for a, b in zip(begins[:-1], begins[1:])]
                        )
                        g = back[:, c]
                        for j in range(width):
                            there = np.minimum(won + j, len(words) - 1)
                            col = column + j * self.filters + f
                            kernel_grad[:, col] += g @ words[there]
                            rows.append(there)
                            row_grads.append(np.outer(g, self.kernel[:, col]))
                    column += width * self.filters
                grads["kernel"] = kernel_grad
                step += 1
                for name, value in params.items():
                    g = grads[name]
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.999 * second[name] + 0.001 * g * g
                    value -= rate * (first[name] / (1 - 0.9**step)) / (
                        np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8
                    )
                self.base -= np.float32(rate * error.sum())
                rows, row_grads = np.concatenate(rows), np.concatenate(row_grads)
                for number in range(len(ids)):
                    slot = ids[number][rows]
                    total = np.zeros((self.slots + 1, self.size), np.float32)
                    np.add.at(total, slot, row_grads)
                    touched = np.unique(slot)
                    touched = touched[np.any(self.embedding[number][touched] != 0, axis=1)]
                    g = total[touched]
                    squared[number][touched] += (g * g).mean(axis=1)
                    self.embedding[number][touched] -= (
                        rate * g / (np.sqrt(squared[number][touched]) + 1e-6)[:, None]
                    )

    def calibrate(self, texts: list[str], labels, languages, least: int = 20):
        """Scale and shift of the logit (logistic fit), then a threshold per language: the middle
        of the widest gap of scores between the best cuts by F1, kept near ``default``. Languages
        with fewer than ``least`` texts of either class keep the default."""
        import numpy as np

        labels = np.asarray(labels, float)
        raw = self.logits(texts)
        # Targets a little inside 0 and 1, as for any logistic calibration on few rows.
        goal = np.where(labels == 1, (labels.sum() + 1) / (labels.sum() + 2), 1 / ((1 - labels).sum() + 2))
        a, b = 1.0, 0.0
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(a * raw + b, -40, 40)))
            w = p * (1 - p) + 1e-9
            g = np.array([((p - goal) * raw).sum(), (p - goal).sum()])
            h = np.array([[(w * raw * raw).sum(), (w * raw).sum()], [(w * raw).sum(), w.sum()]])
            step = np.linalg.solve(h + 1e-6 * np.eye(2), g)
            a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
            if abs(step).max() < 1e-9:
                break
        if a > 0:
            self.scale, self.shift = float(a), float(b)
        score = self.scores(texts)
        languages = np.asarray([str(x) for x in languages])
        for language in np.unique(languages):
            own = languages == language
            s, y = score[own], labels[own]
            if y.sum() < least or (1 - y).sum() < least:
                continue
            cuts = np.unique(np.concatenate([s, [self.default]]))
            f1 = np.array([2 * (y * (s >= c)).sum() / (y.sum() + (s >= c).sum()) for c in cuts])
            best = cuts[f1 >= f1.max() - 1e-12]
            self.thresholds[language] = float(best[np.abs(best - self.default).argmin()])


def sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, language: str | None, per_class: int):
    """At most ``per_class`` labelled texts of each class, picked by a hash of the key, of the
    rows with ``crc32(key) mod 3`` other than 1. Several labels of one key: the largest counts."""
    one = (
        labels.where(quoted(key).isNotNull() & quoted(label).isNotNull())
        .where(F.crc32(quoted(key).cast("string").cast("binary")) % 3 != 1)
        .groupBy(quoted(key).alias("_key"))
        .agg(F.max(quoted(label)).cast("int").alias("_label"))
    )
    order = [F.xxhash64("_key"), F.col("_key")]
    # Ids first, so that the texts of all other rows are never moved.
    picked = None
    for value in (0, 1):
        part = one.where(F.col("_label") == value).orderBy(*order).limit(2 * per_class)
        picked = part if picked is None else picked.unionByName(part)
    own = docs.select(
        quoted(key).alias("_key"),
        whole(quoted(text)).alias("_text"),
        (quoted(language) if language else F.lit("")).cast("string").alias("_lang"),
    )
    # Both sides of the union are limits, at most 4 x per_class ids: safe to broadcast.
    joined = own.join(F.broadcast(picked), "_key")
    got = []
    for value in (0, 1):
        rows = joined.where(F.col("_label") == value).orderBy(*order, F.xxhash64("_text")).limit(per_class)
        got += [(r["_text"], value, r["_lang"]) for r in rows.collect()]
    return got


def fit(docs, labels, key="doc_id", text="text", label="toxic", language="lang", per_class=2500) -> Classifier | None:
    """The trained and calibrated classifier; None without labelled texts of both classes."""
    import zlib

    rows = sample(docs, labels, key, text, label, language, per_class)
    if len({y for _, y, _ in rows}) < 2:
        return None
    # A quarter of the sample calibrates; the other rows train. Texts, not places, decide.
    aside = [zlib.crc32(t.encode()) % 4 == 0 for t, _, _ in rows]
    train = [r for r, a in zip(rows, aside) if not a]
    held = [r for r, a in zip(rows, aside) if a]
    if len({y for _, y, _ in train}) < 2:
        train = rows
    model = Classifier()
    model.train([t for t, _, _ in train], [y for _, y, _ in train])
    if len({y for _, y, _ in held}) == 2:
        model.calibrate(*map(list, zip(*held)))
    return model


def score(docs: DataFrame, text: str, model: Classifier | None, language: str | None = "lang") -> DataFrame:
    """Add ``score`` (0 to 1) and ``rejected`` (score at the language's threshold or above).

    Whole texts are scored, the score reads nothing else. A null text is read as empty; an
    empty text has the score of no answer from any filter; without a model every score is 0.
    Unknown and null languages take the default threshold. Other columns are kept, repeated
    rows get equal scores, a column named ``score`` or ``rejected`` raises.
    """
    if clash := {"score", "rejected"} & {c.lower() for c in docs.columns}:
        raise ValueError(f"the documents already have {sorted(clash)}")
    if model is None:
        return docs.withColumns({"score": F.lit(0.0), "rejected": F.lit(False)})
    schema = T.StructType(
        [
            *docs.schema.fields,
            T.StructField("score", T.DoubleType()),
            T.StructField("rejected", T.BooleanType()),
        ]
    )
    at = docs.columns.index(text)
    tongue = docs.columns.index(language) if language else None
    # Arrays and numbers only, of a size fixed by the classifier's parameters.
    shared = docs.sparkSession.sparkContext.broadcast(dict(vars(model)))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        own = Classifier.__new__(Classifier)
        vars(own).update(shared.value)
        for batch in batches:
            texts = [v or "" for v in batch.column(at).to_pylist()]
            scores = [own.scores(texts[a:b]) for a, b in chunks([len(t) for t in texts])]
            scores = np.concatenate(scores) if scores else np.empty(0)
            if tongue is None:
                limits = np.full(len(texts), own.default)
            else:
                limits = [own.thresholds.get(str(v), own.default) for v in batch.column(tongue).to_pylist()]
            rejected = scores >= np.asarray(limits, float)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                names=schema.names,
            )

    return docs.mapInArrow(run, schema)


@query()
def op4_text_cnn(spark, sf_dir):
    """Every document's score; labels of the held-out third are never read for training."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, "text", model).select(
        "doc_id",
        (F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3, F.lit(0)) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
        F.col("rejected").alias("rejected_for_language"),
    )
