import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairmatch.llm.resampling import Checksums, Scheme, features, pieces, resample


def plain(text, scheme=Scheme()):
    words = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
    runs = [words[i : i + n] for n in range(1, scheme.longest + 1) for i in range(len(words) - n + 1)]
    return [zlib.crc32(b" ".join(r)) % scheme.buckets for r in runs], len(words)


def sample_texts(seed=1):
    rng = random.Random(seed)
    odd = ["", None, "a", "a b", "A É ß日本 x " + "z" * 60 + " q " + "y" * 1000 + " k", "\0 \0a\0b", " ", "... --- ..."]
    some = [" ".join("".join(rng.choices("abcé-", k=rng.randint(1, 90))) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    return odd + some


def test_features_of_joined_texts_equal_those_of_each_text():
    rng = random.Random(2)
    texts = [t or "" for t in sample_texts()]
    # Longer than several parts, with long words: n-grams over the parts' borders count once.
    texts.append(" ".join("".join(rng.choices("abc", k=rng.choice([1, 4, 9, 47, 48, 49, 130]))) for _ in range(60_000)))
    got = [[] for _ in texts]
    for _, owner, own in features(texts, Scheme(), Checksums()):
        for i in np.unique(owner):
            got[i] += own[owner == i].tolist()
    assert [Counter(g) for g in got] == [Counter(plain(t)[0]) for t in texts]


def test_parts_end_between_words():
    text = b"ab cd" * 400 + b"x" * 3000 + b" " + b"y" * 10
    cut = list(pieces(len(text), text, 64))
    assert cut[0][0] == 0 and cut[-1][1] == len(text)
    assert all(a[1] == b[0] and text[a[1] - 1 : a[1]] == b" " for a, b in zip(cut, cut[1:]))


def brute(rows, target, scheme=Scheme()):
    s, t = Counter(), Counter()
    counted = [(key, *plain(text)) for key, text in rows]
    for _, own, _ in counted:
        s.update(own)
    for text in target:
        t.update(plain(text)[0])
    gain = lambda b: math.floor(
        1000 * math.log((t[b] + 1) * (s.total() + scheme.buckets) / ((s[b] + 1) * (t.total() + scheme.buckets)))
    )
    out = []
    for key, own, words in counted:
        weight = sum(map(gain, own))
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((key, words, len(own), weight, weight + noise))
    enough = sorted((r for r in out if r[1] >= scheme.least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = enough[: scheme.percent * len(enough) // 100]
    return Counter([(*r, i + 1) for i, r in enumerate(drawn)] + [(*r, None) for r in [*out]]) - Counter((*r, None) for r in drawn)


def test_weights_and_ranks_equal_brute_force(spark):
    rng = random.Random(5)
    texts = sample_texts(3) + [" ".join(rng.choices([f"w{i}" for i in range(400)], k=rng.randint(15, 60))) for _ in range(500)]
    rows = [(i // 2 if i % 7 == 0 else i, t) for i, t in enumerate(texts)] + [(None, texts[-1]), (None, texts[-2])]
    target = texts[100:130] + [None, ""]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bucket", F.lit(1))
    got = resample(docs.repartition(5), spark.createDataFrame([(t,) for t in target], "text string"))
    assert Counter(tuple(r) for r in got.collect()) == brute(rows, target)


def test_empty_tables_and_clashes(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(30)))], "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    assert [(r.doc_id, r.n_features, r["rank"]) for r in resample(docs, none).collect()] == [(1, 87, None)]
    assert resample(docs.limit(0), none).count() == 0
    kept = resample(docs.withColumn("kind", F.lit("k")), none, keep=["kind"])
    assert kept.columns == ["doc_id", "kind", "n_words", "n_features", "weight", "score", "rank"]
    with pytest.raises(ValueError, match="already have"):
        resample(docs.withColumn("Score", F.lit(1)), none, keep=["Score"])
