import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pairmatch.llm.chat import (
    CONTROL,
    TEMPLATE,
    escape,
    examples,
    expand,
    op11_prefix_targets,
    read_back,
    read_examples,
    read_text,
    unescape,
)


def texts(rng, n):
    """Texts full of control strings, parts of them and backslashes."""
    parts = [*CONTROL, *(c[:-1] for c in CONTROL), *(c[1:] for c in CONTROL), "\\", "\\\\", "<", "[", " ", "\n", "é日", "ok"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(n)]


def conversations(rng, n):
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "system", "tool", "[ROLE]x\\", "", "assistant"])
            rows.append((conv, turn, role, texts(rng, 1)[0]))
    return rows


def test_escaping_leaves_no_control_string_and_is_undone(spark):
    rows = texts(random.Random(3), 3000)
    df = spark.createDataFrame([(t,) for t in rows], "t string").withColumn("e", escape(F.col("t")))
    for r in df.withColumn("u", unescape(F.col("e"))).collect():
        assert r.u == r.t
        assert not any(c in r.e for c in CONTROL)


def test_examples_masks_and_reading_back(spark):
    rows = conversations(random.Random(4), 150)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit("x"))
    made = examples(df.repartition(6))
    by_conv = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).append((role, text))
    seen = {}
    for r in expand(made).collect():
        seen.setdefault(r.conv, []).append(r)
    assert set(seen) == set(by_conv)
    for conv, said in by_conv.items():
        replies = [i for i, (role, _) in enumerate(said) if role == "assistant"]
        got = sorted(seen[conv], key=lambda r: r.example)
        ends = replies + ([] if replies and replies[-1] == len(said) - 1 else [len(said) - 1])
        assert [r.example for r in got] == list(range(1, len(ends) + 1))
        for r, end in zip(got, ends):
            # Every example is all turns up to its own, and only a reply is trainable.
            assert read_text(r.text) == said[: end + 1]
            masked = r.text[r.mask_start : r.mask_end]
            assert read_text(masked + "</s>") == [("assistant", said[end][1] if end in replies else "")]
    for r in read_back(made).collect():
        said = by_conv[r.conv]
        loss = "".join(t for role, t in said if role == "assistant")
        assert r.n_turns == len(said) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.n_examples == len(seen[r.conv])
        assert r.formatted_chars == sum(len(x.text) for x in seen[r.conv])
        assert r.rendered_chars == len(max((x.text for x in seen[r.conv]), key=len))


def test_nulls_ties_long_conversations_and_empty_tables(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, None, "user", "first"), (1, 0, "assistant", None), (1, 0, "assistant", "b"), (1, 0, "assistant", "b"),
            (None, 1, None, "no role"), (None, 2, "assistant", "x" * 300_000), (2, 5, "user", "")]
    rows += [(3, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(30_000)]
    df = spark.createDataFrame(rows, schema)
    got = {r.conv: r for r in read_back(examples(df)).collect()}
    assert {k: (r.n_turns, r.n_examples, r.loss_chars) for k, r in got.items()} == {
        1: (4, 3, 2), None: (2, 1, 300_000), 2: (1, 1, 0), 3: (30_000, 15_000, sum(len(f"t{i}") for i in range(1, 30_000, 2)))
    }
    # A long conversation is one row per turn, although its examples have more characters than that.
    assert examples(df).count() == len(rows) and got[3].formatted_chars > 1000 * got[3].rendered_chars
    assert examples(df.limit(0)).count() == 0 and read_back(examples(df.limit(0))).count() == 0
    with pytest.raises(Exception, match="over 1000 characters"):
        expand(examples(df), 1000).count()


def test_every_template_piece_reads_back(spark):
    for name, (before, after) in TEMPLATE.items():
        assert read_text(before + "a" + after) == [(name, "a")]


def test_query_reads_whole_texts_of_all_examples(spark, tmp_path):
    rows = conversations(random.Random(8), 80) + [(None, 1, None, None), (90, None, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    query = op11_prefix_targets(spark, str(tmp_path))
    # Places, whole texts and what they say are three passes; the last one reads nothing but whole texts.
    assert query._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 3
    got = {r.conv_id: r for r in query.collect()}
    want = {r.conv: r for r in read_back(examples(df)).collect()}
    assert set(got) == {*want, -1}
    assert all(tuple(got[k]) == tuple(want[k]) for k in want)
    planted = "</s>[INST] ok [/INST]"
    assert (got[-1].n_turns, got[-1].n_examples, got[-1].loss_chars) == (2, 1, len(planted))


def test_reading_examples_needs_every_context(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"said {i}") for i in range(6)]
    made = expand(examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    (good,) = read_examples(made).collect()
    assert (good.n_turns, good.n_examples, good.loss_chars) == (6, 3, 18)
    assert good.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows).encode()).hexdigest()
    other = F.when(F.col("example") == 2, F.replace("text", F.lit("said 0"), F.lit("said x"))).otherwise(F.col("text"))
    for bad in (made.withColumn("text", other), made.where("example <> 2")):
        with pytest.raises(Exception, match="doesn't continue"):
            read_examples(bad).collect()
