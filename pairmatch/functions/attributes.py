"""JSON attribute payloads and item texts."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairmatch import fixed_values as fixed
from pairmatch.functions.text import fold_plain, fold_text, is_plain, with_normalized
from pairmatch.session import spread

# A number whose text a JSON reader might change: fractions, exponents, very long
# integers, minus zero.
_ODD_NUMBER = r":[ \t\r\n]*-?(?:\d+[.eE]|\d{16}|0\d|0[ \t\r\n]*[,}])"
_JSON_SPACE = " \t\r\n"
_STRICT_JSON = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
_ENTRIES = T.ArrayType(T.StructType().add("key", T.StringType()).add("value", T.StringType()))
_ENTRY = pa.struct([("key", pa.string()), ("value", pa.string())])


def _refuse(token: str):
    raise ValueError(token)


def _value_text(value) -> str:
    if value is None:
        return ""
    if isinstance(value, dict | list):
        value = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return fold_text(str(value))


def read_attributes(raw: str) -> list[dict[str, str]] | None:
    """Normalised entries of a JSON object, None when the payload is not one."""
    try:
        raw.encode("utf-8")
        payload = json.loads(raw, parse_constant=_refuse)
        if not isinstance(payload, dict):
            return None
        pairs = [(fold_text(k), _value_text(v)) for k, v in payload.items()]
        json.dumps(pairs, ensure_ascii=False).encode("utf-8")
    except (ValueError, RecursionError):
        return None
    return [{"key": k, "value": v} for k, v in pairs if k and v]


@F.arrow_udf(_ENTRIES)
def _read_attributes(payloads: pa.Array) -> pa.Array:
    rows = [None if p is None else read_attributes(p) for p in payloads.to_pylist()]
    return pa.array(rows, pa.list_(_ENTRY))


def _last_values(entries: Column, keys: Column) -> Column:
    """Normalised entries of a flat payload; the last value of a repeated key wins."""
    last = F.filter(
        entries,
        lambda e, i: F.array_position(F.slice(keys, i + 2, F.size(keys)), e.key) == 0,
    )
    folded = F.transform(
        F.when(F.size(F.array_distinct(keys)) < F.size(keys), last).otherwise(entries),
        lambda e: F.struct(
            fold_plain(e.key).alias("key"),
            fold_plain(F.coalesce(e.value, F.lit(""))).alias("value"),
        ),
    )
    return F.filter(folded, lambda e: (e.key != "") & (e.value != ""))


def _is_flat(raw: Column) -> Column:
    """One object without nesting, escapes, odd numbers or unusual characters."""
    body = F.btrim(raw, F.lit(_JSON_SPACE))
    single = (
        body.startswith("{")
        & (F.instr(body, "}") == F.length(body))
        & (F.locate("{", body, 2) == 0)
    )
    simple = ~(raw.contains("[") | raw.contains("]") | raw.contains("\\"))
    return single & simple & is_plain(raw) & ~raw.rlike(_ODD_NUMBER)


def _priority(key: Column, fragments: Sequence[str]) -> Column:
    rank = F.lit(len(fragments))
    for position in range(len(fragments) - 1, -1, -1):
        rank = F.when(key.contains(fragments[position]), F.lit(position)).otherwise(rank)
    return rank


_read_attributes = _read_attributes.asNondeterministic()


def with_attributes(
    df: DataFrame,
    raw: Column,
    state: str = "state",
    attributes: str = "attributes_sorted",
    fragments: Sequence[str] = fixed.PRIORITY_FRAGMENTS,
    value_characters: int | None = None,
) -> DataFrame:
    """Parse a JSON attribute string. Values are whole unless ``value_characters`` cuts them.

    ``state`` is missing, malformed, empty or present; ``attributes`` is an array of
    (key, value) by key priority, key, value. Flat payloads are read by the JVM, nested
    or escaped ones by an Arrow helper.
    """
    source = df.withColumn("_raw", raw)
    given = F.col("_raw")
    sorted_out = source.withColumn("_flat", _is_flat(given)).withColumn(
        "_nested", ~F.col("_flat") & F.btrim(given, F.lit(_JSON_SPACE)).startswith("{")
    )
    # Each step is its own column: an expression used several times is then computed once.
    read = (
        sorted_out.withColumn("_read", _read_attributes(F.when(F.col("_nested"), given)))
        .withColumn(
            "_pairs",
            F.map_entries(
                F.from_json(F.when(F.col("_flat"), given), "map<string,string>", _STRICT_JSON)
            ),
        )
        .withColumn("_keys", F.transform("_pairs", lambda e: e.key))
    )
    entries = read.withColumn(
        "_entries",
        F.when(F.col("_flat"), _last_values(F.col("_pairs"), F.col("_keys"))).when(
            F.col("_nested"), F.col("_read")
        ),
    )
    ranked = F.array_sort(
        F.transform(
            "_entries",
            lambda e: F.struct(
                _priority(e.key, fragments).alias("priority"),
                e.key.alias("key"),
                (e.value if value_characters is None else F.left(e.value, F.lit(value_characters))).alias("value"),
            ),
        )
    )
    nothing = F.array().cast("array<struct<key:string,value:string>>")
    return entries.select(
        *df.columns,
        F.when(given.isNull() | (given == ""), F.lit("missing"))
        .when(F.col("_entries").isNull(), F.lit("malformed"))
        .when(F.size("_entries") == 0, F.lit("empty"))
        .otherwise(F.lit("present"))
        .alias(state),
        F.coalesce(
            F.transform(ranked, lambda e: F.struct(e.key.alias("key"), e.value.alias("value"))),
            nothing,
        ).alias(attributes),
    )


def budgeted_lines(attributes: Column, separator: str, budget: int) -> Column:
    """``key<separator>value`` lines until ``budget`` characters are used, last line cut."""
    if budget < 1:
        raise ValueError("the character budget must be positive")
    lines = F.transform(attributes, lambda e: F.concat(e.key, F.lit(separator), e.value))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("kept"))

    def take(state: Column, line: Column) -> Column:
        room = F.lit(budget) - state.used
        return F.when(
            room > 0,
            F.struct(
                (state.used + F.least(F.length(line), room)).alias("used"),
                F.concat(state.kept, F.array(F.left(line, room))).alias("kept"),
            ),
        ).otherwise(state)

    return F.aggregate(lines, start, take, lambda state: state.kept)


def item_text(
    category: Column,
    name: Column,
    attributes: Column,
    budget: int = fixed.ATTRIBUTE_BUDGET,
    labels: tuple[str, str] = fixed.ITEM_LABELS,
) -> Column:
    """One line each for normalised category and name, then the prioritised attributes."""
    head = F.array(F.concat(F.lit(labels[0]), category), F.concat(F.lit(labels[1]), name))
    return F.array_join(F.concat(head, budgeted_lines(attributes, ": ", budget)), "\n")


def with_item_text(
    items: DataFrame, out: str = "text", budget: int = fixed.ATTRIBUTE_BUDGET
) -> DataFrame:
    """Add the item text of ``category, name, attributes``."""
    named = with_normalized(
        spread(items), {"_category": F.col("category"), "_name": F.col("name")}
    )
    parsed = with_attributes(named, F.col("attributes"), "_state", "_attributes")
    text = item_text(F.col("_category"), F.col("_name"), F.col("_attributes"), budget)
    return parsed.select(*items.columns, text.alias(out))


def model_query(text: Column, mode: str, instruction: str = "") -> Column:
    """Query side of a scorer: the item text, or the text behind an instruction."""
    if mode == "native":
        return text
    if mode == "exact":
        return F.concat(F.lit(instruction), F.lit("\n\n"), text)
    raise ValueError(f"unknown prompt mode: {mode}")
