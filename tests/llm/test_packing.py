import collections
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairmatch.llm.packing import fill, fillings, op7_bin_slack, pack

PATH = public_tokenizers.path("byte_bpe_50k.json")


def best_sum(counts, first, capacity):
    left = dict(counts)
    left[first] -= 1
    sums = {first}
    for length, n in left.items():
        sums = {s + k * length for s in sums for k in range(n + 1) if s + k * length <= capacity}
    return max(sums)


def test_fill_is_the_closest_sum():
    rng = random.Random(3)
    for _ in range(400):
        counts = {rng.randint(1, 60): rng.randint(1, 4) for _ in range(rng.randint(1, 7))}
        first = max(counts)
        taken = fill(counts, first, 64)
        assert taken[first] >= 1 and all(n <= counts[length] for length, n in taken.items())
        assert sum(n * length for length, n in taken.items()) == best_sum(counts, first, 64)


def test_fillings_use_every_length():
    counts = {700: 10, 324: 7, 100: 90, 1: 3}
    used = collections.Counter()
    for taken, times in fillings(dict(counts), 1024):
        assert sum(n * length for length, n in taken.items()) <= 1024
        for length, n in taken.items():
            used[length] += n * times
    assert used == counts
    rest = dict(counts)
    for taken, _ in fillings(rest, 1024, exact=True):
        assert sum(n * length for length, n in taken.items()) == 1024
    assert rest


def check(rows, texts, capacity=1024):
    library = Tokenizer.from_file(PATH)
    ids = {k: np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for k, t in texts.items()}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        own = ids[r.doc_id]
        assert bytes(r.ids) == own[r.start : r.start + r.length].tobytes() and r.doc_tokens == len(own)
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for k, own in ids.items():
        ends = list(itertools.accumulate(n for _, n in sorted(pieces[k])))
        assert [s for s, _ in sorted(pieces[k])] == [0, *ends[:-1]] and ends[-1] == len(own)
    for parts in sequences.values():
        ends = list(itertools.accumulate(n for _, n in sorted(parts)))
        assert [s for s, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= capacity
    return sum(map(len, ids.values())), len(sequences)


def test_round_trip_and_padding(spark):
    rng = random.Random(6)
    words = "alpha beta gamma delta épée <|endoftext|> 12 ,".split()
    texts = {i: " ".join(rng.choices(words, k=rng.randint(0, 900))) for i in range(400)}
    texts |= {1000: None, 1001: "", 1002: "word " * 9000, 1003: " " * 300_000 + "x"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("task", F.lit(1))
    for partitions in (1, 40):
        tokens, sequences = check(pack(df.repartition(partitions), "doc_id", "text", PATH).collect(), texts)
        assert sequences <= tokens / 1024 * 1.02 + 2


def test_small_pool_and_empty_table(spark):
    texts = {i: "a b c d " * (i % 37) for i in range(300)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check(pack(df, "doc_id", "text", PATH, capacity=128, pool=5).collect(), texts, 128)
    assert pack(df.limit(0), "doc_id", "text", PATH).count() == 0


def test_repeated_and_null_keys_and_the_query(spark, tmp_path):
    rows = [(1, "same"), (1, "same"), (None, "x"), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op7_bin_slack(spark, str(tmp_path)).collect()
    assert len(got) == 4 and sorted(r.offset for r in got) != [0, 0, 0, 0]
    assert len({(r.sequence_id, r.offset) for r in got}) == 4
    assert zlib.crc32(np.array([0], "<u4").tobytes()) in {r.ids_crc32 for r in got}
