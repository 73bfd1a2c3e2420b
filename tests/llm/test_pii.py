import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from pairmatch.llm.pii import BASE, FEATURES, Trees, calibrated, candidates, detect, op3_boosted_pii, redact, select, learn, summary


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        total += int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10))
    return total % 10 == 0


def slow(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0])):
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(digits(m[0])) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return sorted(out)


def test_base_spans_equal_the_plain_patterns(spark, tmp_path):
    rng = random.Random(2)
    texts = []
    for letters in ("0123456789" * 3 + "+-.() ()@ab\n٣é👍", "ab@.-_+@. 1", "12345.255.0. 1"):
        texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 100))) for _ in range(1200)]
    texts += ["", "1" * 30_000, "a" * 100_000 + "@b.c", "+" + "1" * 20_000, "x@y.z " * 1500, "000.01.2.0255", "4111 1111-1111 1111"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(-1, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op3_boosted_pii(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        want = slow(text or "")
        spans = [f"{k}:{a}:{b}" for a, _, k, b in want]
        assert got[i].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(w[2] == k for w in want) for k in BASE]
        assert set(spans) <= set(got[i].spans.split(",")) | {""}


def card(rng, valid):
    while True:
        digits = "".join(rng.choice("0123456789") for _ in range(16))
        if luhn(digits) == valid:
            return " ".join(digits[i : i + 4] for i in range(0, 16, 4))


def test_trees_select_slips_among_confirmed_cards(spark):
    rng = random.Random(3)
    rows = [(i, f"pay with card {card(rng, i % 30 > 0)} now") for i in range(900)]
    rows += [(1000 + i, f"order {rng.randint(10**11, 10**12)} came") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = candidates(df, "text", "c")
    model, limits = learn(found, "c")
    got = {r.doc_id: r.pii for r in select(found, "c", model, limits, "pii").collect()}
    slips = [i for i in range(0, 900, 30)]
    assert sum(any(s.name.startswith("likely_") for s in got[i]) for i in slips) >= 25
    # Numbers of another form are confirmed by chance alone, and stay.
    assert sum(any(s.name.startswith("likely_") for s in got[1000 + i]) for i in range(400)) < 10
    # The expression gives the score of the fitted trees.
    rows = found.select(F.explode("c").alias("s")).select("s.f", model.column(F.col("s.f")).alias("p")).limit(200).collect()
    assert all(abs(model.score(tuple(r.f)) - r.p) < 1e-12 for r in rows)


def test_trees_learn_and_thresholds_hold():
    shape = [1] * len(FEATURES)
    yes, no = tuple([0, 5, *shape[2:]]), tuple([0, 1, *shape[2:]])
    model = Trees().fit([(yes, 1, 90), (yes, 0, 2), (no, 0, 80), (no, 1, 1)])
    assert model.score(yes) > 0.8 > 0.2 > model.score(no)
    limits = calibrated(model, [(yes, 1, 95), (yes, 0, 5), (no, 0, 100)], 0.9)
    assert limits[0] == model.score(yes) and limits[1] == 2.0
    assert Trees().fit([]).score(yes) == 0.5


def test_redaction_merges_overlaps_and_keeps_the_rest(spark):
    text = "é👍 mail a.b@c.org and +1 (415) 555-2671 or 10.0.0.1."
    rows = [(1, text), (1, text), (2, None), (3, ""), (4, "nothing here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_v_email", F.lit(7))
    clean = redact(detect(df, "text", "spans"), "text", "spans").collect()
    assert clean[0].asDict() == {"doc_id": 1, "text": "é👍 mail [EMAIL] and [PHONE] or [IP].", "_v_email": 7}
    assert [r.text for r in clean] == [clean[0].text, clean[0].text, None, "", "nothing here"]
    both = spark.createDataFrame([(1, "x +378282246310005 y")], "doc_id long, text string")
    got = redact(detect(both, "text", "spans"), "text", "spans").first().text
    # A phone with its sign, and the same digits as a card.
    assert got == "x [PHONE] y"


def test_empty_table_and_clash(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert summary(detect(df, "text", "pii", ["doc_id"]), "doc_id").count() == 0
    with pytest.raises(ValueError):
        detect(df.withColumn("PII", F.lit(1)), "text", "pii")


def test_written_out_addresses_and_national_phones_are_selected(spark):
    rng = random.Random(5)
    name = lambda: "".join(rng.choices("abcdefghij", k=7))
    phone = lambda: f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    rows = [(i, f"write to {name()} (at) {name()} (dot) com today") for i in range(300)]
    rows += [(1000 + i, f"meet {name()} (at) {name()}. Then {name()}") for i in range(100)]
    rows += [(2000 + i, f"please call {phone()} today") for i in range(300)]
    rows += [(3000 + i, f"order {rng.randint(10**11, 10**12)} came") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [s.name for s in r.pii] for r in detect(df, "text", "pii", ["doc_id"]).collect()}
    assert sum(got[i] == ["likely_spelt"] for i in range(300)) == 300
    assert sum(got[2000 + i] == ["likely_number"] for i in range(300)) == 300
    assert sum(bool(got[1000 + i]) for i in range(100)) + sum("likely_number" in got[3000 + i] for i in range(200)) < 10


def plain_choice(spans, picked):
    """Confirmed spans, and in order of starts those picked that lie over none of them and no earlier one."""
    sure = [s for s in spans if s.sure]
    over = lambda a, b: a.start < b.end and b.start < a.end
    more = []
    for s in spans:
        if not s.sure and picked(s) and not any(over(s, o) for o in [*sure, *more]):
            more.append(s)
    names = [(s.start, s.end, s.name if s.sure else "likely_" + s.name) for s in [*sure, *more]]
    return sorted(names, key=lambda n: n[:2]), names


def test_selected_spans_and_redaction_equal_plain_loops(spark):
    rng = random.Random(11)
    letters = "0123456789" * 3 + "+-.() ()@ab"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 400))) for _ in range(800)]
    texts += [f"x@y.z {rng.randint(10**9, 10**15)} +1 (415) 555-{i:04d} é👍 " * rng.randint(1, 40) for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = candidates(df, "text", "c").cache()
    model, limits = learn(found, "c")
    limits = {k: 0.02 for k in limits}
    chosen = select(found.withColumn("kept", F.col("c")), "c", model, limits, "pii")
    clean = {r.doc_id: r.text for r in redact(chosen.select("doc_id", "text", "pii"), "text", "pii").collect()}
    some = 0
    for r in chosen.collect():
        want = plain_choice(r.kept, lambda s: model.score(tuple(s.f)) >= limits[s.rank])[1]
        assert sorted((s.start, s.end, s.name) for s in r.pii) == sorted(want)
        some += sum(name.startswith("likely_") for _, _, name in want)
        merged = []
        for s in r.pii:
            if merged and s.start < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], s.end)
            else:
                merged.append([s.start, s.end, s.name])
        out, at = "", 0
        for a, b, name in merged:
            out, at = out + r.text[at:a] + f"[{name.upper()}]", b
        assert clean[r.doc_id] == out + r.text[at:]
    assert some > 100
    found.unpersist()


LONG = {
    "dots": "a (at) b" + " (dot) c" * 100_000,
    "addresses": "x@y.z " * 100_000,
    "digits": "1" * 200_000,
    "apart": "1 " * 100_000,
    "signs": "+1" * 100_000,
    "mixed": "call +1 415 555 2671 or a (at) b (dot) com " * 10_000,
}


@pytest.mark.parametrize("name", LONG)
def test_long_texts_take_linear_time(spark, name):
    df = spark.createDataFrame([(1, LONG[name]), (2, "mail a@b.c")], "doc_id long, text string")
    started = time.perf_counter()
    got = {r.doc_id: r for r in summary(detect(df, "text", "pii", ["doc_id"]), "doc_id").collect()}
    assert got[2].n_email == 1
    clean = redact(detect(df, "text", "pii"), "text", "pii").collect()
    assert clean[1].text == "mail [EMAIL]" and time.perf_counter() - started < 60
