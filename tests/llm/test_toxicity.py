import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairmatch.llm.toxicity import PREFIXES, WIDTHS, Classifier, fit, score
from pairmatch.llm.words import PUNCTUATION, word_hashes


def corpus(n=700, seed=2):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(900)]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.randint(20, 120))
        toxic = int(i % 5 == 0)
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["zzrude", "zznasty", "qqvile" + rng.choice("abc")]))
        docs.append((i, " ".join(words), rng.choice(["en", "de", None])))
        labels.append((i, toxic))
    return docs, labels


def frames(spark, docs, labels):
    return (
        spark.createDataFrame(docs, "doc_id long, text string, lang string"),
        spark.createDataFrame(labels, "doc_id long, toxic int"),
    )


def test_held_out_accuracy_and_no_peeking(spark):
    docs, labels = corpus()
    frame, marks = frames(spark, docs, labels)
    model = fit(frame, marks)
    got = {r.doc_id: r.score for r in score(frame, "text", model).collect()}
    held = [(got[i], y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    ones, noughts = [s for s, y in held if y], [s for s, y in held if not y]
    better = sum((a > b) + 0.5 * (a == b) for a in ones for b in noughts) / (len(ones) * len(noughts))
    assert len(ones) > 20 and better > 0.97
    assert sum((s >= 0.7) == (y == 1) for s, y in held) > 0.93 * len(held)
    # Turned labels of the held-out rows change nothing.
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    again = {r.doc_id: r.score for r in score(frame, "text", fit(frame, frames(spark, docs, turned)[1])).collect()}
    assert again == got


def test_score_reads_the_text_alone(spark):
    docs, labels = corpus(300)
    model = fit(*frames(spark, docs, labels))
    rows = [(1, docs[0][1], "en"), (2, docs[0][1], "xx"), (3, docs[0][1], None), (4, None, "en"), (5, "", "en")]
    rows += [(6, "zzrude " * 60_000, "en"), (7, "\0  .,;", "en")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("toxic", F.lit(1))
    got = {r.doc_id: r for r in score(frame, "text", model).collect()}
    assert got[1].score == got[2].score == got[3].score and got[4].score == got[5].score == got[7].score
    assert got[6].score > 0.7 > got[5].score and all(0 <= r.score <= 1 for r in got.values())
    assert "toxic" in got[1].asDict() and score(frame.limit(0), "text", model).count() == 0
    with pytest.raises(ValueError):
        score(frame.withColumn("Score", F.lit(1)), "text", model)


def test_without_labels_nothing_is_rejected(spark):
    docs, labels = corpus(60)
    frame, marks = frames(spark, docs, labels)
    for some in (marks.limit(0), marks.where("toxic = 0"), marks.withColumn("toxic", F.lit(None).cast("int"))):
        model = fit(frame, some)
        assert model is None
        assert {(r.score, r.rejected) for r in score(frame, "text", model).collect()} == {(0.0, False)}
    # Two labels of one row: the larger one counts, the row is trained on once.
    assert fit(frame, marks.unionByName(marks.withColumn("toxic", F.lit(0)))) is not None


def plain_score(model, text):
    """The network word by word: sums of embeddings, filters at every place, the largest answers, a logit."""
    counts, features = word_hashes([text.lower().encode()], PUNCTUATION, PREFIXES)
    words = []
    for i in range(int(counts[-1])):
        rows = [int(f[i] >> np.uint64(17)) % model.slots for f in features]
        words.append(sum(model.embedding[k][row].astype(float) for k, row in enumerate(rows)))
    words += [np.zeros(model.size)] * max(WIDTHS)
    logit, column = float(model.base), 0
    for k, width in enumerate(WIDTHS):
        for f in range(model.filters):
            kernel = [model.kernel[:, column + j * model.filters + f].astype(float) for j in range(width)]
            places = range(len(words) - width + 1)
            best = max(sum(float(words[i + j] @ kernel[j]) for j in range(width)) for i in places)
            c = k * model.filters + f
            logit += max(best + float(model.bias[c]), 0.0) * float(model.out[c])
        column += width * model.filters
    return 1 / (1 + np.exp(-(model.scale * logit + model.shift)))


def test_scores_equal_a_plain_forward_pass():
    rng = random.Random(8)
    model = Classifier(slots=512)
    texts = ["", "one", "two words", "Ünï cödé, 日本!"] + [
        " ".join("".join(rng.choices("abcde", k=rng.randint(1, 12))) for _ in range(rng.randint(1, 80))) for _ in range(60)
    ]
    model.train(texts, [i % 2 for i in range(len(texts))], epochs=2, batch=16, least=1)
    model.bias += np.float32(0.05)
    assert np.allclose(model.scores(texts), [plain_score(model, t) for t in texts], atol=1e-5)


def test_scores_are_the_same_bits_in_any_company():
    rng = random.Random(9)
    docs, labels = corpus(200)
    texts = [t for _, t, _ in docs]
    model = Classifier()
    model.train(texts, [y for _, y in labels], epochs=1)
    alone = [float(model.scores([t])[0]) for t in texts]
    for size in (2, 3, 7, 50, 200):
        order = rng.sample(range(len(texts)), len(texts))
        for first in range(0, len(order), size):
            part = order[first : first + size]
            assert model.scores([texts[i] for i in part]).tolist() == [alone[i] for i in part]
