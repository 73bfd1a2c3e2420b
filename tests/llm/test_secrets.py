import hashlib
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from pairmatch.llm.secrets import ALPHABET, START, fit, op2_markov_secrets, scan


def slow_base(text):
    out = []
    for m in re.finditer(
        r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text
    ):
        if len(m[1]) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    for rank, kind, pattern, least in ((1, "access", "AKIA[A-Z0-9]+", 20), (2, "hex", "[0-9a-f]+", 24)):
        out += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(out)]


def test_base_spans_equal_the_plain_patterns(spark, tmp_path):
    rng = random.Random(4)
    bits = ["token", "PassWord", "api_key", "apikey", "ſecret", "=", ":", " ", '"', "'", "AKIA", "ABCD0123", "deadbeef", "0f", "é", "👍", "x", "-"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ["AKIA" + "Z" * 16, "AKIA" + "Z" * 15, "a" * 24, "a" * 23, "secret=secret=abcdef", "token: 12345", "f" * 100_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(9999, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op2_markov_secrets(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and got[9999].spans == ""
    for i, text in rows:
        want = slow_base(text or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [
            sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex")
        ]
        assert [s for s in got[i].spans.split(",") if s and not s.startswith("markov")] == want


def test_models_find_random_strings_and_leave_identifiers(spark):
    rng = random.Random(8)
    words = ["customer", "session", "handler", "default", "response", "message", "connection", "internal", "service"]
    key = lambda n: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n))
    rows = [(i, " ".join(rng.choices(words, k=60)) + f' token = "{key(30)}"') for i in range(200)]
    lost = [key(32) for _ in range(30)]
    names = ["_".join(rng.choices(words, k=3)) for _ in range(30)] + ["customerSessionHandlerDefault"]
    rows += [(1000 + i, f"see {k} there") for i, k in enumerate(lost)]
    rows += [(2000 + i, f"see {n} there") for i, n in enumerate(names)]
    got = {r.doc_id: r.secrets for r in scan(spark.createDataFrame(rows, "doc_id long, text string"), "text").collect()}
    assert sum(any(s.kind == "markov" and s.value == k for s in got[1000 + i]) for i, k in enumerate(lost)) >= 29
    assert all(not got[2000 + i] for i in range(len(names)))
    assert all([s.kind for s in got[i]] == ["assign"] for i in range(200))


def test_fit_is_the_log_ratio():
    ratio = fit([(0, START, 0, 10), (1, 0, 1, 3)], smoothing=1.0, flat=len(ALPHABET))
    n = len(ALPHABET)
    from math import isclose, log

    assert isclose(ratio[START][0], log(1 / n) - log(11 / (10 + n)))
    assert isclose(ratio[0][1], log(4 / (3 + n)) - log(1 / n))
    assert all(isclose(x, 0, abs_tol=1e-12) for row in fit([], flat=n) for x in row)


def test_empty_table_and_clash(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert scan(empty, "text").count() == 0
    with pytest.raises(ValueError):
        scan(empty.withColumn("Secrets", F.lit(1)), "text")


def test_secrets_behind_long_names_and_paths(spark):
    rng = random.Random(9)
    words = ["customer", "session", "handler", "default", "response", "message", "connection", "internal", "service"]
    key = lambda n: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n))
    rows = [(i, " ".join(rng.choices(words, k=60)) + f' token = "{key(30)}"') for i in range(200)]
    keys = [key(24) for _ in range(60)]
    heads = ["internal_customer_service_message_connection=", "/service/internal/customer/connection/", "token=abcdef:"]
    rows += [(1000 + i, f"see {heads[i % 3]}{k} there") for i, k in enumerate(keys)]
    rows += [(2000 + i, "see " + "/".join(rng.choices(words, k=8)) + " there") for i in range(60)]
    got = {r.doc_id: r.secrets for r in scan(spark.createDataFrame(rows, "doc_id long, text string"), "text").collect()}
    assert sum(any(s.kind == "markov" and k in s.value for s in got[1000 + i]) for i, k in enumerate(keys)) >= 55
    assert all(len(s.value) < 40 for i in range(60) for s in got[1000 + i])
    assert not any(got[2000 + i] for i in range(60))
