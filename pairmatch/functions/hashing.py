"""Seeded row hashes for splits, samples and shuffles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Leading 60 bits of the md5 of the joined values: any SQL engine computes the same
# number. `xxhash64` is the cheaper choice where nothing outside Spark compares.
_BITS = {"md5": 60, "xxhash64": 64}


def seeded_hash(seed: int | None, *columns: str | Column, method: str = "md5") -> Column:
    """Uniform bigint of the columns: 0..2^60-1 for md5, the signed range for xxhash64."""
    values = [F.col(c) if isinstance(c, str) else c for c in columns]
    head = [] if seed is None else [F.lit(seed)]
    if method == "xxhash64":
        return F.xxhash64(*head, *values)
    if method != "md5":
        raise ValueError(f"unknown hash method: {method}")
    text = F.concat_ws("|", *[v.cast("string") for v in [*head, *values]])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def hash_slot(value: Column, slots: int, method: str = "md5") -> Column:
    """Even ranges of a uniform hash, in hash order, for ``ranking.ordinal``."""
    bits = max(1, (slots - 1).bit_length())
    return F.shiftright(value, _BITS[method] - bits).cast("int")


def unit_interval(value: Column) -> Column:
    """Uniform double in [0, 1) from an md5-based hash."""
    return value.cast("double") / F.lit(float(2**60))
