import random
import string

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairmatch.llm.bpe import PrefixEncoder, WordTokenizer, tokenize

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "<|endoftext|>a <|startoftext|><|ENDOFTEXT|>b<|endoftext|>́", "a" * 5000, "ab" * 3000,
    "ΑΣ Σίσυφος İstanbul ẞ ﬁ ǅ", "한글 각 日本語 👍🏽", "x‍﻿\x00\x1c\x85　y", "it's we'll I'D 12½²",
]


def test_ids_and_decoding_equal_the_library():
    rng = random.Random(5)
    letters = "abcdeft ABCΣ \t\n'sll12٣_-<|>é日👍" + string.ascii_lowercase
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    ours, library = WordTokenizer(PATH, cache=500), Tokenizer.from_file(PATH)
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        ids = np.frombuffer(ours.encode(text), np.int32).tolist()
        assert ids == want.ids
        assert ours.decode(ids) == library.decode(want.ids, skip_special_tokens=False)


def test_every_code_point_is_treated_as_the_library_does():
    ours, library = WordTokenizer(PATH), Tokenizer.from_file(PATH)
    points = [p for p in (*range(0x32000), *range(0x32000, 0x110000, 97)) if not 0xD800 <= p < 0xE000]
    # One text per point, so that no odd letter sends its neighbours the library's way.
    texts = [f"ab{chr(p)}cd 1{chr(p)}2 {chr(p)}'s !{chr(p)}" for p in points]
    for first in range(0, len(texts), 4096):
        part = texts[first : first + 4096]
        for text, want in zip(part, library.encode_batch(part, add_special_tokens=False)):
            assert np.frombuffer(ours.encode(text), np.int32).tolist() == want.ids, text
    assert len(ours.odd) < 0.05 * len(points)


def plain_bpe(word, merges):
    parts = list(word)
    ranks = {pair: i for i, pair in enumerate(merges)}
    while len(parts) > 1:
        rank, at = min((ranks.get(p, len(merges)), i) for i, p in enumerate(zip(parts, parts[1:])))
        if rank == len(merges):
            break
        parts[at : at + 2] = ["".join(parts[at : at + 2])]
    return parts


def test_prefix_programming_equals_merging_for_random_merge_lists():
    for seed in range(40):
        rng = random.Random(seed)
        vocab, merges = list("ab c"), []
        while len(merges) < 25:
            pair = (rng.choice(vocab), rng.choice(vocab))
            if "".join(pair) not in vocab:
                merges.append(pair)
                vocab.append("".join(pair))
        numbers = {t: i for i, t in enumerate(vocab)}
        encoder = PrefixEncoder({"vocab": numbers, "merges": [list(m) for m in merges]})
        for _ in range(60):
            word = "".join(rng.choice("ab c") for _ in range(rng.randint(1, 30)))
            assert [vocab[i] for i in encoder.encode(word)] == plain_bpe(word, merges)


def test_nulls_empties_repeats_and_clashes(spark):
    rows = [(1, None), (2, ""), (3, "Some text"), (3, "Some text"), (4, "z " * 20000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("kept"))
    got = tokenize(df, "text", PATH).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 5 and by[1].ids == [] and by[1].decoded == "" and by[2].ids == []
    assert len(by[4].ids) == 20000 and by[3].id == "kept"
    assert tokenize(df.limit(0), "text", PATH).count() == 0
    with pytest.raises(ValueError):
        tokenize(df.withColumn("Ids", F.lit(1)), "text", PATH)
