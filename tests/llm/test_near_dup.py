import random

import numpy as np
from pyspark.sql import functions as F

from pairmatch.llm.near_dup import (
    Plan,
    Sampler,
    agreeing,
    classes,
    dealt_blocks,
    joined_roots,
    keep_one,
    op8_weighted_minhash,
    shingles,
)


def words(rng, n):
    return ["".join(rng.choices("abcdefghij", k=5)) for _ in range(n)]


def corpus(seed=4):
    """Originals, copies with edits, a passage that most documents share, and a crowd of copies."""
    rng = random.Random(seed)
    passage = words(rng, 40)
    texts = []
    for i in range(120):
        own = words(rng, rng.randint(60, 200)) + (passage if i % 2 else [])
        texts.append(own)
        for _ in range(i % 3):
            copy = list(own)
            for _ in range(rng.randint(0, max(1, len(copy) // 40))):
                copy[rng.randrange(len(copy))] = "edited"
            texts.append(copy)
    crowd = words(rng, 150)
    for _ in range(150):
        copy = list(crowd)
        copy[rng.randrange(len(copy))] = rng.choice("xyzuvw")
        texts.append(copy)
    return [" ".join(t) for t in texts]


def true_classes(texts, least=0.8):
    sets = [set(s.tolist()) for s, _ in shingles(texts, 5)]
    head = list(range(len(texts)))

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j] or (sets[i] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])):
                a, b = find(i), find(j)
                head[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_classes_equal_all_pairs(spark):
    texts = corpus() + ["", "", " ", "a b", "a  b", "a b", "one two three four", "z " * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("uid", F.lit(1))
    got = {r.id: r for r in classes(df.repartition(7), "doc_id", "text").collect()}
    assert [got[i].class_id for i in range(len(texts))] == true_classes(texts)
    assert sum(r.kept for r in got.values()) == len(set(true_classes(texts)))
    kept = keep_one(df, "doc_id", "text")
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(true_classes(texts)))


def test_agreement_of_samples_is_the_weighted_similarity():
    rng = np.random.default_rng(5)
    sampler = Sampler(Plan(samples=2400), 1000, {})
    pool = rng.integers(1, 1 << 60, 300).astype(np.uint64)
    for share in (0.3, 0.6, 0.85):
        both = int(300 * share)
        left = (np.sort(pool[:both]), rng.integers(1, 4, both))
        a = np.sort(np.concatenate([pool[: both // 2], pool[both:]]))
        right = (a, np.ones(len(a), np.int64))
        _, i, j = np.intersect1d(left[0], right[0], return_indices=True)
        x, y = sampler.weights(*left), sampler.weights(*right)
        joint = np.minimum(x[i], y[j]).sum()
        want = joint / (x.sum() + y.sum() - joint)
        agree = (sampler.samples(*left) == sampler.samples(*right)).mean()
        assert abs(agree - want) < 0.06


def test_nulls_repeats_and_empty_tables(spark):
    body = " ".join(words(random.Random(1), 30))
    rows = [(5, body), (5, body), (None, body), (5, "other text of some length here"), (7, None), (8, ""), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = classes(df, "doc_id", "text").collect()
    assert len(got) == 7
    sizes = sorted((r.class_id, r.class_rows) for r in got if r.kept)
    assert sizes == [(5, 1), (5, 3), (7, 3)]
    assert len(keep_one(df, "doc_id", "text").collect()) == 3
    assert classes(df.limit(0), "doc_id", "text").count() == 0
    assert keep_one(df.limit(0), "doc_id", "text").count() == 0


def test_frequent_passages_weigh_less(spark, tmp_path):
    texts = corpus()
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op8_weighted_minhash(spark, str(tmp_path)).collect()
    assert len(got) == len(texts) and set(got[0].asDict()) == {"doc_id", "class_id", "class_rows", "kept", "text_class"}
    from pairmatch.llm.near_dup import feature_counts

    size, often = feature_counts(spark.createDataFrame([(t,) for t in texts], "text string"), "text", Plan())
    assert size == len(texts) and often
    sampler = Sampler(Plan(), size, often)
    assert sampler.idf.min() < sampler.idf.max()


def family(rng, n, shared):
    """Texts of one template with seven words of their own each, at 0.786 to all others; texts 0 and 1,
    2 and 3, ... of the last quarter share ``shared`` of the words, which makes 0.81 of one."""
    template = words(rng, 296)
    texts = []
    for i in range(n):
        own = [f"own{i}x{j}" for j in range(7)]
        if i >= n - n // 4 and i % 2:
            own[:shared] = [f"own{i - 1}x{j}" for j in range(shared)]
        text = list(template)
        for j, word in enumerate(own):
            text[20 + 40 * j] = word
        texts.append(" ".join(text))
    return texts


def test_pairs_of_a_large_template_family(spark):
    texts = family(random.Random(6), 360, 1)
    want = true_classes(texts)
    assert 45 * 2 == sum(c > 1 for c in np.unique(want, return_counts=True)[1]) * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # With equal weights the weighted similarity is the plain one.
    got = {r.id: r.class_id for r in classes(df.repartition(5), "doc_id", "text", Plan(floor=1.0, block=64)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_pairs_that_only_their_shingle_sets_link(spark):
    rng = random.Random(7)
    texts = []
    for _ in range(40):
        head, line, tail = words(rng, 40), words(rng, 20), words(rng, 40)
        texts += [" ".join(head + line * times + tail) for times in (3, 40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r.class_id for r in classes(df, "doc_id", "text").collect()}
    assert [got[i] for i in range(len(texts))] == true_classes(texts) == [i - i % 2 for i in range(len(texts))]


def test_plain_samples_are_those_of_equal_weights():
    rng = np.random.default_rng(9)
    hashes = np.unique(rng.integers(1, 1 << 62, 6000).astype(np.uint64))
    ones, counts = np.ones(len(hashes), np.int64), rng.integers(1, 4, len(hashes))
    sampler = Sampler(Plan(), 1000, {})
    weighted, plain = sampler.both_samples(hashes, counts)
    assert (plain == sampler.samples(hashes, ones)).all() and not (plain == weighted).all()


def test_texts_of_a_key_meet_across_all_its_blocks(spark):
    texts = family(random.Random(8), 160, 1)
    want = true_classes(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plan = Plan(floor=1.0, block=4, samples=48, plain=False)
    got = {r.id: r.class_id for r in classes(df.repartition(5), "doc_id", "text", plan).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_every_two_classes_of_a_key_meet_in_one_unit(spark):
    rng = random.Random(9)
    # One class of most texts, small classes, and texts alone.
    rows = [(7, i, 0 if i < 300 else i - i % (3 if i < 330 else 1)) for i in range(360)] + [(8, i, i % 2) for i in range(5)]
    signs = {i: rng.randbytes(96) for i in range(360)}
    members = spark.createDataFrame(rows, "band long, uid long, root long")
    texts = spark.createDataFrame([(i, s, 10) for i, s in signs.items()], "uid long, signs binary, chars long")
    units = {}
    for r in dealt_blocks(members, texts, Plan(block=16)).collect():
        units.setdefault((r.band, r.left, r.right), []).append(r)
    met = {}
    for (band, left, right), of in units.items():
        assert len({r.root for r in of}) > 1 and {r.block for r in of} == {left, right}
        for i, a in enumerate(of):
            for b in of[:i]:
                if a.root != b.root and (left == right or a.block != b.block):
                    pair = (band, *sorted((a.uid, b.uid)))
                    met[pair] = met.get(pair, 0) + 1
    want = {(x[0], *sorted((x[1], y[1]))) for x in rows for y in rows if x[0] == y[0] and x[2] != y[2]}
    assert set(met) == want and set(met.values()) == {1}


def test_no_agreeing_text_of_a_large_class_is_left_out(spark):
    same, half = bytes(range(96)), bytes(range(60)) + bytes(36)
    rows = [(1, 0, 0, 0, i, 0, same) for i in range(40)] + [(1, 0, 0, 0, 99, 99, half)]
    dealt = spark.createDataFrame(
        rows, "band long, left long, right long, block long, uid long, root long, signs binary"
    )
    assert {r.uid for r in agreeing(dealt, Plan(plain=False)).collect()} == {*range(40), 99}
    assert len(agreeing(dealt, Plan(plain=False), 3).collect()) == 4


def test_roots_after_further_links(spark):
    roots = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5), (9, 8), (8, 8)], "id long, root long")
    links = spark.createDataFrame([(6, 2), (20, 9), (31, 30)], "id1 long, id2 long")
    got = {r.id: r.root for r in joined_roots(roots, links).collect()}
    assert got == {1: 1, 2: 1, 5: 1, 6: 1, 8: 8, 9: 8, 20: 8, 30: 30, 31: 30}
