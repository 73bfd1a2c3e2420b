import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairmatch.functions import attributes as A
from pairmatch.functions import text as X
from pairmatch.operators import scoring
from pairmatch.operators.prompts import teacher_prompts

ITEM = "id long, category string, name string, attributes string"


def normalized(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.n for r in X.with_normalized(df, {"n": F.col("v")}).orderBy("i").collect()]


def parsed(spark, payloads):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i int, p string")
    rows = A.with_attributes(df, F.col("p")).orderBy("i").collect()
    return [(r.state, [(e.key, e.value) for e in r.attributes_sorted]) for r in rows]


def texts(spark, rows, mode="pair", **options):
    """Pair table of consecutive item rows, in both orders."""
    items = spark.createDataFrame(rows, ITEM)
    ids = [r[0] for r in rows]
    pairs = [(a, b) for a, b in zip(ids[::2], ids[1::2], strict=True)]
    pairs += [(b, a) for a, b in pairs]
    df = spark.createDataFrame(pairs, "id1 long, id2 long")
    out = scoring.evidence_table(df, items, mode, **options)
    return {(r.id1, r.id2): r for r in out.collect()}


def test_normalisation_examples(spark):
    given = ["\x0bTÜRKIS  Blau ", "Щётка", "Fußball", "½ ﬀ", None, "p\x00q\x1fr", "ñ", " "]
    want = ["türkis blau", "щетка", "fussball", "1⁄2 ff", "", "p q r", "ñ", ""]
    assert normalized(spark, given) == want


@settings(max_examples=1, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=12),
                min_size=300, max_size=300))
def test_jvm_and_python_normalisation_agree(spark, values):
    plain = ["ÀÉß Ёё «x» – Ђ", "A\tB\nC", *values, *[v.encode("ascii", "ignore").decode() for v in values]]
    assert normalized(spark, plain) == [X.fold_text(v) for v in plain]


def test_attribute_payload_states(spark):
    got = parsed(
        spark,
        [
            None, "", "not-json", "[]", "{}", '{"a":" "}', "{'a':1}", '{"a":NaN}', '{"a":1} x',
            '{"a":01}', '{"a":"x"',
        ],
    )
    assert [s for s, _ in got] == [
        "missing", "missing", "malformed", "malformed", "empty", "empty", "malformed",
        "malformed", "malformed", "malformed", "malformed",
    ]


def test_priority_keys_come_first_then_names(spark):
    payload = '{"zoom":"4","color tint":"x","sku":"7","объем бака":"3","mpn":"q","вес нетто":"2"}'
    order = [k for k, _ in parsed(spark, [payload])[0][1]]
    assert order == ["mpn", "объем бака", "вес нетто", "color tint", "sku", "zoom"]


@pytest.mark.parametrize(
    ("payload", "want"),
    [
        ('{"w":7.250,"on":false,"none":null}', [("on", "false"), ("w", "7.25")]),
        ('{"box":{"y":[3],"x":"u"},"n":2e2}', [("box", '{"x":"u","y":[3]}'), ("n", "200.0")]),
        ('{"dup":"first","dup":"last"}', [("dup", "last")]),
        ('{"\\u00a0Tab\\u0009":"Q"}', [("tab", "q")]),
        ('{"r":-3.125,"s":98765432.5}', [("r", "-3.125"), ("s", "98765432.5")]),
    ],
)
def test_attribute_values(spark, payload, want):
    assert parsed(spark, [payload])[0][1] == want


def test_long_values_stay_whole_unless_a_limit_is_given(spark):
    flat, nested = '{"note":"' + "y" * 900 + '"}', '{"note":["' + "y" * 900 + '"]}'
    whole = parsed(spark, [flat, nested])
    assert whole[0][1] == [("note", "y" * 900)] and len(whole[1][1][0][1]) == 904
    df = spark.createDataFrame([(flat,), (nested,)], "p string")
    cut = A.with_attributes(df, F.col("p"), value_characters=5).collect()
    assert [r.attributes_sorted[0].value for r in cut] == ["yyyyy", '["yyy']


def test_jvm_and_python_attribute_readers_agree(spark):
    flat = ['{"b":"1","a":"2"}', '{"A":"x","a":"y"}', '{"a":"","b":"ё"}', '{"n":5,"t":false}']
    read = [sorted((e["key"], e["value"]) for e in A.read_attributes(p)) for p in flat]
    assert [sorted(entries) for _, entries in parsed(spark, flat)] == read


def test_item_text_is_ordered_and_cut_at_its_budget(spark):
    turned = ['{"weight":"9","brand":"Orbis","note":"n"}', '{"note":"n","brand":"Orbis","weight":"9"}']
    items = spark.createDataFrame([(i, "Garden", "Rake", p) for i, p in enumerate(turned)], ITEM)
    one, two = (r.text for r in A.with_item_text(items).orderBy("id").collect())
    assert one == two and one.splitlines()[2:] == ["brand: orbis", "note: n", "weight: 9"]
    # Twelve characters for the first attribute, and three of the next.
    assert A.with_item_text(items, budget=15).first().text.splitlines()[2:] == ["brand: orbis", "not"]
    for wrong in (lambda: A.with_item_text(items, budget=0), lambda: A.model_query(F.lit("t"), "other")):
        with pytest.raises(ValueError):
            wrong()


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("3,2 л", "3200 ml"), ("75мл", "75 ml"), ("6шт", "6 pcs"), ("4 штуки", "4 pcs"),
        ("8.40 см", "84 mm"), ("002 кг", "2000 g"), ("0,3 метра", "300 mm"), ("0.0г", "0 g"),
        ("A-Line", "a line"), ("58", "58"), ("кг", "kg"), ("7x9 mm", "7x9 mm"), ("", ""),
    ],
)
def test_comparison_values(value, want):
    assert X.compare_text(value) == want


def test_comparison_paths_agree(spark):
    values = ["brand#x", "полный набор", "500мл", "0,5л", "a-b_c", "кг", "№5", "ⅷ см"]
    df = spark.createDataFrame([(i, X.fold_text(v)) for i, v in enumerate(values)], "i int, v string")
    out = X.with_comparison_values(df, "c", F.array("v")).orderBy("i").collect()
    assert [r.c[0] for r in out] == [X.compare_text(v) for v in values]


def test_measures_are_converted_alike_in_the_jvm(spark):
    rng = random.Random(12)
    bits = ["0", "5", "12", "007", "1.50", "3,25", ",", ".", " ", "x", "л", "мл", "литра", "кг", "г", "гр",
            "см", "m", "mm", "штук", "pcs", "-", "_", "é", "м2", "a-b"]
    values = [X.fold_text("".join(rng.choice(bits) for _ in range(rng.randint(1, 8)))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    out = df.select("i", X.compare_plain(F.col("v")).alias("c")).orderBy("i").collect()
    assert [r.c for r in out] == [X.compare_text(v) for v in values]


def test_title_identifiers(spark):
    df = spark.createDataFrame([("acme x100 a-200/b 12 7 foo x100 модель_5",)], "t string")
    assert df.select(X.title_identifiers(F.col("t")).alias("i")).first().i == [
        "a200b", "x100", "модель5",
    ]


def test_surface_similarity_edges(spark):
    rows = [("", "A"), ("A", "a"), ("A", "B"), (None, None), ("ACME X100", "ACME X200"), ("яа", "аб")]
    df = spark.createDataFrame(rows, "l string, r string")
    got = [r.s for r in X.with_byte_similarity(df, "s", F.col("l"), F.col("r")).collect()]
    assert got[:4] == [0.0, 1.0, 0.0, 0.0]
    assert 0.0 < got[4] < 1.0
    assert got[5] == pytest.approx(0.4)  # byte sets, not letters


def test_byte_sets_match_python(spark):
    values = ["", "a", "Hello World", "яабв Яё", "日本語", "straße 5€", "\u0000x", "aa bb"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = df.select("i", X.byte_set(F.col("v")).alias("b")).orderBy("i").collect()
    for row, value in zip(got, values, strict=True):
        want = set(value.lower().encode("utf-8")) if value else set()
        assert {ord(c) for c in row.b if c} == want
        if value:
            assert len(row.b) == len(want)


KETTLE = '{"brand":"Orbis","model":"K-7","volume":"1.7 л","color":"red"}'


def test_pair_text_is_the_same_both_ways(spark):
    rows = [
        (11, "Kitchen", "Orbis kettle K-7 1.7 л", KETTLE),
        (12, "Kitchen", "Kettle Orbis K-7", '{"volume":"1700мл","model":"k 7","brand":"ORBIS"}'),
    ]
    got = texts(spark, rows)
    there, back = got[11, 12], got[12, 11]
    assert there.left_text == back.left_text and there.right_text == back.right_text == ""
    shared = there.left_text.split("[MATCH] ")[1].split("\n")[0].split("; ")
    assert shared == ["brand=orbis", "model=k 7", "volume=1700 ml"]
    assert (there.identity_matches, there.identity_conflicts, there.missing_identity_fields) == (3, 0, 1)
    assert "[MISSING_IDENTITY] color" in there.left_text


def test_pair_text_shows_states_and_conflicts(spark):
    rows = [(21, "Kitchen", "Kettle K900", KETTLE), (22, "Kitchen", "Kettle K901", "{broken")]
    row = texts(spark, rows)[22, 21]
    assert "[ATTRIBUTES] malformed" in row.left_text and "[ATTRIBUTES] present" in row.left_text
    assert "title_id=k900<>k901" in row.left_text and "[MATCH] none" in row.left_text
    assert (row.identity_conflicts, row.missing_identity_fields) == (1, 4)


def test_verdicts_read_all_and_whole_values(spark):
    brands = ",".join(f'"brand {c}":"{v}"' for c, v in zip("abcde", "pqrst"))
    tail = "z" * 600
    rows = [
        (31, "c", "n", "{" + brands + ',"model":"' + tail + '1"}'),
        (32, "c", "n", '{"brand":"t","model":"' + tail + '2"}'),
    ]
    row = texts(spark, rows)[31, 32]
    # The fifth brand matches; models that differ behind 600 characters do not.
    assert "brand=t" in row.left_text and row.identity_matches == 1 and row.identity_conflicts == 1


def test_units_are_compared_in_base_form(spark):
    rows = [
        (41, "c", "n", '{"volume":"0,25л","pack":"3шт","weight":"1.2 кг"}'),
        (42, "c", "n", '{"volume":"250 миллилитров","pack":"3 штуки","weight":"1200г"}'),
    ]
    row = texts(spark, rows)[41, 42]
    assert "[MATCH] volume=250 ml; weight=1200 g; pack=3 pcs" in row.left_text
    assert row.identity_conflicts == 0


def test_prompts_turn_around_and_carry_rules(spark):
    items = spark.createDataFrame([(51, "Tools", "Saw 18V", None), (52, "Tools", "Saw 36V", None)], ITEM)
    pairs = spark.createDataFrame([(51, 52)], "id1 long, id2 long")
    ruled = teacher_prompts(pairs, items, "category_rules", {"tools": "Volts decide."}).collect()
    forward, backward = sorted(ruled, key=lambda r: r.direction, reverse=True)
    assert (forward.direction, backward.direction) == ("forward", "backward")
    assert (forward.left_text, forward.right_text) == (backward.right_text, backward.left_text)
    assert all("Volts decide." in r.prompt for r in ruled) and forward.prompt != backward.prompt
    with pytest.raises(ValueError):
        teacher_prompts(pairs, items, "free")


def test_batch_scorer_sees_every_row_once(spark):
    rows = [(i, "c", f"name {i}" + "x" * (i % 5), None) for i in range(1, 21)]
    items = spark.createDataFrame(rows, ITEM)
    pairs = spark.createDataFrame([(i, i + 1) for i in range(1, 20)], "id1 long, id2 long")
    table = scoring.evidence_table(pairs, items)
    scorer = scoring.batch_scorer(lambda f: (f.left_text.str.len() - 2 * f.right_text.str.len()))
    one = {(r.id1, r.id2): r for r in scoring.score_pairs(table, scorer).collect()}
    both = {(r.id1, r.id2): r.score for r in scoring.score_pairs(table, scorer, True).collect()}
    assert len(one) == len(both) == 19
    for key, row in one.items():
        l, r = len(row.left_text), len(row.right_text)
        assert row.score == l - 2 * r
        assert both[key] == -(l + r) / 2
