"""Text normalisation and comparison values."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairmatch import fixed_values as fixed

# Strings made of these characters are already NFKC, and lower-casing them equals case
# folding (apart from the sharp s, replaced below), so the JVM handles them alone.
PLAIN = r"\x00-\x7FÀ-ÖØ-öø-ÿЀ-џ«»–—"


def fold_text(value: str) -> str:
    """NFKC, case folding, io to ie, control characters and white space to one space."""
    folded = unicodedata.normalize("NFKC", value).casefold().replace("ё", "е")
    return " ".join(re.sub(r"[\x00-\x1f\x7f]", " ", folded).split())


@F.arrow_udf(T.StringType())
def _fold_text(values: pa.Array) -> pa.Array:
    folded = [None if v is None else fold_text(v) for v in values.to_pylist()]
    return pa.array(folded, pa.string())


def fold_plain(value: Column) -> Column:
    """``fold_text`` for strings of PLAIN characters, as a built-in expression."""
    lowered = F.translate(F.replace(F.lower(value), F.lit("ß"), F.lit("ss")), "ё", "е")
    return F.trim(F.regexp_replace(lowered, r"[\x00-\x20\x7F]+", " "))


def is_plain(value: Column) -> Column:
    """As many bytes as characters means ASCII; only other strings are searched."""
    return (F.octet_length(value) == F.length(value)) | ~value.rlike(f"[^{PLAIN}]")


# Marked nondeterministic so that the optimizer runs it once per row instead of copying
# the call into every expression that reads the result.
_fold_text = _fold_text.asNondeterministic()


def with_normalized(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add normalised texts, ``''`` for null. Only unusual strings reach the Arrow helper."""
    kept = [*df.columns]
    source = df.select(
        "*",
        *[value.alias(f"_text_{out}") for out, value in columns.items()],
        *[is_plain(value).alias(f"_plain_{out}") for out, value in columns.items()],
    )
    folded = source.select(
        "*",
        *[
            _fold_text(F.when(~F.col(f"_plain_{out}"), F.col(f"_text_{out}"))).alias(f"_odd_{out}")
            for out in columns
        ],
    )
    return folded.select(
        *[c for c in kept if c not in columns],
        *[
            F.when(F.col(f"_text_{out}").isNull(), F.lit(""))
            .when(F.col(f"_plain_{out}"), fold_plain(F.col(f"_text_{out}")))
            .otherwise(F.col(f"_odd_{out}"))
            .alias(out)
            for out in columns
        ],
    )


def _alternatives(words) -> str:
    return "|".join(sorted(words, key=len, reverse=True))


_UNIT_OF_WORD = {word: unit for unit, words in fixed.UNIT_WORDS.items() for word in words}
_UNIT_WORD = rf"\b(?:{_alternatives(_UNIT_OF_WORD)})\b"
_MEASURE = (
    rf"(?<![{fixed.WORD_CHARACTERS}])(\d+(?:\.\d+)?)\s*({_alternatives(fixed.ATTACHED_UNITS)})\b"
)


def _in_base_unit(match: re.Match) -> str:
    base, factor = fixed.BASE_UNITS[fixed.ATTACHED_UNITS[match.group(2)]]
    amount = Decimal(match.group(1)) * factor
    whole = amount.to_integral_value()
    # `format` keeps the fraction's trailing zeros, an integer has none to cut.
    shown = f"{whole:f}" if amount == whole else f"{amount:f}".rstrip("0")
    return f"{shown} {base}"


def compare_text(value: str) -> str:
    """Units in base form, everything but letters and digits to single spaces."""
    text = re.sub(r"(?<=\d),(?=\d)", ".", fold_text(value))
    text = re.sub(_UNIT_WORD, lambda m: _UNIT_OF_WORD[m.group()], text)
    text = re.sub(_MEASURE, _in_base_unit, text)
    return " ".join(re.sub(rf"[^{fixed.WORD_CHARACTERS}]+", " ", text).split())


@F.arrow_udf(T.ArrayType(T.StringType()))
def _compare_texts(values: pa.Array) -> pa.Array:
    compared = [
        None if row is None else [None if v is None else compare_text(v) for v in row]
        for row in values.to_pylist()
    ]
    return pa.array(compared, pa.list_(pa.string()))


_compare_texts = _compare_texts.asNondeterministic()

# Attached units by how many places their factor moves the decimal point.
_PLACES = {
    unit: (fixed.BASE_UNITS[name][0], len(str(fixed.BASE_UNITS[name][1])) - 1)
    for unit, name in fixed.ATTACHED_UNITS.items()
}


def _moved(number: Column, places: int) -> Column:
    """A decimal number as text, its point moved to the right, without idle zeros."""
    fraction = F.concat(F.regexp_extract(number, r"\.(\d+)$", 1), F.lit("0" * places))
    digits = F.concat(F.regexp_extract(number, r"^\d+", 0), F.substring(fraction, 1, places))
    head = F.regexp_replace(digits, r"^0+(?=\d)", "")
    tail = F.regexp_replace(F.substring(fraction, places + 1, 1 << 30), r"0+$", "")
    return F.when(tail == "", head).otherwise(F.concat(head, F.lit("."), tail))


def _based(number: Column, unit: Column) -> Column:
    out = F.lit(None).cast("string")
    for base, places in sorted(set(_PLACES.values())):
        units = [u for u, target in _PLACES.items() if target == (base, places)]
        out = F.when(unit.isin(units), F.concat(_moved(number, places), F.lit(f" {base}"))).otherwise(out)
    return out


def _unit_words(value: Column) -> Column:
    """Decimal commas as points and unit words in their short form; rows without either are only searched."""
    text = F.when(value.contains(","), F.regexp_replace(value, r"(?<=\d),(?=\d)", ".")).otherwise(value)
    replaced = text
    for unit, words in fixed.UNIT_WORDS.items():
        replaced = F.regexp_replace(replaced, rf"(?U)\b(?:{_alternatives(words)})\b", unit)
    return F.when(text.rlike(rf"(?U){_UNIT_WORD}"), replaced).otherwise(text)


def _measured(text: Column) -> Column:
    """Measures in base form."""
    measure = f"(?U){_MEASURE}"
    based = F.zip_with(
        F.regexp_extract_all(text, F.lit(measure), F.lit(1)),
        F.regexp_extract_all(text, F.lit(measure), F.lit(2)),
        _based,
    )
    # Text between the measures and the measures in turn; the last piece has none behind it.
    pieces = F.zip_with(
        F.split(text, measure, -1), based, lambda piece, b: F.concat(piece, F.coalesce(b, F.lit("")))
    )
    return F.when(text.rlike("[0-9]"), F.array_join(pieces, "")).otherwise(text)


def compare_plain(value: Column) -> Column:
    """``compare_text`` for normalised strings of PLAIN characters, as a built-in expression."""
    return F.get(_compared_plain(F.array(value)), F.lit(0))


def _compared_plain(values: Column) -> Column:
    """``compare_plain`` of every value of an array.

    Each step is a pass over the array, since inside one lambda a text that is read several
    times would be derived anew each time.
    """
    measured = F.transform(F.transform(values, _unit_words), _measured)
    return F.transform(measured, lambda v: F.trim(F.regexp_replace(v, rf"[^{fixed.WORD_CHARACTERS}]+", " ")))


def with_comparison_values(df: DataFrame, out: str, values: Column) -> DataFrame:
    """Add the comparison forms of an array of normalised values.

    Plain values stay in the JVM, measurements included; arrays that hold an unusual
    character go through the Arrow helper.
    """
    staged = df.withColumn("_values", values).withColumn(
        "_odd", F.exists("_values", lambda v: ~is_plain(v))
    )
    compared = staged.withColumn("_compared", _compare_texts(F.when(F.col("_odd"), F.col("_values"))))
    return compared.select(
        *df.columns,
        F.when(F.col("_odd"), F.col("_compared"))
        .otherwise(_compared_plain(F.col("_values")))
        .alias(out),
    )


def title_identifiers(normalized: Column) -> Column:
    """Sorted distinct tokens with a digit and at least three letters or digits."""
    word, part = fixed.WORD_CHARACTERS, fixed.IDENTIFIER_CHARACTERS
    pattern = rf"(?U)(?<![{word}])[{part}]*\d[{part}]*(?![{word}])"
    tokens = F.regexp_extract_all(normalized, F.lit(pattern), F.lit(0))
    bare = F.transform(tokens, lambda t: F.regexp_replace(t, rf"[^{word}]+", ""))
    long_enough = F.filter(bare, lambda t: F.length(t) >= fixed.IDENTIFIER_MINIMUM)
    return F.array_sort(F.array_distinct(long_enough))


def byte_set(text: Column) -> Column:
    """Distinct UTF-8 bytes of the lower-cased text, one Latin-1 character each."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return F.array_distinct(F.split(F.decode(F.encode(lowered, "UTF-8"), "ISO-8859-1"), ""))


def byte_similarity(left: Column, right: Column, left_set: Column, right_set: Column) -> Column:
    """Jaccard of two byte sets; 0 for an empty name, equality for a single character."""
    a, b = (F.lower(F.coalesce(side, F.lit(""))) for side in (left, right))
    shared = F.size(F.array_intersect(left_set, right_set))
    either = F.size(left_set) + F.size(right_set) - shared
    return (
        F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0))
        .when((F.length(a) < 2) | (F.length(b) < 2), (a == b).cast("double"))
        .otherwise(shared.cast("double") / either)
    )


def with_byte_similarity(df: DataFrame, out: str, left: Column, right: Column) -> DataFrame:
    """Add the byte-set similarity of two texts.

    The sets are columns of their own, so each is built once per row.
    """
    sets = df.select(
        "*",
        left.alias("_left"),
        right.alias("_right"),
        byte_set(left).alias("_left_set"),
        byte_set(right).alias("_right_set"),
    )
    return sets.select(
        *[c for c in df.columns if c != out],
        byte_similarity(
            F.col("_left"), F.col("_right"), F.col("_left_set"), F.col("_right_set")
        ).alias(out),
    )
