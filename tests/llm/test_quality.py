import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from pairmatch.llm.quality import judge, measure


def slow(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = collections.Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if count[g] > 1 for j in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


def test_metrics_equal_the_plain_count(spark):
    rng = random.Random(9)
    letters = ["a", "b", "c ", " ", "\n", "\t", "\x0b", "#", "$", "👍", "é", " ", "\x1c", "b\n", "a a b "]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    texts += ["", " \n\n ", "x", "x y", "x y z", "x y z x y z", "w " * 30_000, "v" * 100_000, "l\nl\nl", "l\n l\nl"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(-1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_words", F.lit(1))
    for r in measure(df, "text").collect():
        want = slow(r.text)
        assert {k: r[k] for k in want} == want, r.text


def rows_of(host, good, bad, rng):
    fine = lambda: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(60))
    poor = lambda: " ".join("".join(rng.choices("abcdefgh", k=6)) + "***" for _ in range(60))
    return [(host, fine()) for _ in range(good)] + [(host, poor()) for _ in range(bad)]


def test_host_verdicts_are_shrunk_and_spare_clean_documents(spark):
    rng = random.Random(1)
    data = rows_of("good", 300, 3, rng) + rows_of("bad", 20, 280, rng) + rows_of("tiny", 0, 1, rng)
    data += rows_of(None, 30, 0, rng) + [("good", None), ("good", "too short")]
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(data)], "doc_id long, source string, text string")
    for carried in (None, ["doc_id", "source"]):
        got = judge(df, "text", "source", carried).collect()
        assert len(got) == len(data)
        rate = {r.source: r.host_rate for r in got}
        assert rate["good"] < 0.1 and rate["bad"] > 0.8 and rate[None] < 0.5
        # One failing document is drawn to the corpus, not taken as a rate of one.
        assert rate["tiny"] < 0.99
        for r in got:
            text = data[r.doc_id][1]
            clean = text is not None and len(text.split()) >= 50 and "***" not in text
            assert r.kept if clean else True
            if r.source == "good":
                assert r.kept == (not r.base_failed)
            if r.source == "bad" and not clean:
                assert not r.kept
        assert all(r.base_failed and not r.kept for r in got if data[r.doc_id][1] in (None, "too short"))


def test_empty_table_repeats_and_clash(spark):
    df = spark.createDataFrame([(1, "s", "w " * 60)] * 3, "doc_id long, source string, text string")
    got = judge(df, "text", "source").collect()
    assert len(got) == 3 and all(r.base_failed for r in got)
    assert judge(df.limit(0), "text", "source").count() == 0
    with pytest.raises(ValueError):
        judge(df.withColumn("Kept", F.lit(1)), "text", "source")


def test_later_filters_stay_above_the_text_work(spark):
    df = spark.createDataFrame([(1, "s", "w " * 60)], "doc_id long, source string, text string")
    plan = judge(df, "text", "source").where("kept")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate inline" in plan
    below = plan[plan.index("Generate inline") :]
    assert not any("n_words" in line and "Filter" in line for line in below.splitlines())
