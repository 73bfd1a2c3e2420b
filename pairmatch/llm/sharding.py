"""Hierarchical weighted hash tree: rows descend region, rack and shard by weighted draws.

Every child of a node draws ``ln(u) / weight`` for a row, with ``u`` in (0, 1) a hash of the
child's name and the row's key, and the largest draw wins. A child wins with a probability
in proportion to its weight, and a draw depends on nothing but the child, so a changed
weight moves rows only into or out of the child it belongs to: all other draws stay. Shards
added as a region of their own therefore take rows into themselves and move no other row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairmatch.llm.common import fresh, query, quoted, table
from pairmatch.session import shuffle_width


@dataclass(frozen=True)
class Node:
    """A region, rack or shard; ``shard`` is the number of a leaf, ``own`` its weight."""

    name: str
    children: tuple["Node", ...] = ()
    shard: int = -1
    own: float = 1.0
    weight: float = field(init=False)

    def __post_init__(self):
        total = sum(c.weight for c in self.children) if self.children else self.own
        if total < 0:
            raise ValueError(f"{self.name}: a weight is not negative")
        object.__setattr__(self, "weight", float(total))


def tree(regions: Sequence[Sequence[Sequence[float]]]) -> Node:
    """Shard weights by region and rack; shards are numbered in the order given.

    A node's name is its path (``r0/k1/s0``), so adding a region at the end, a rack at the
    end of a region or a shard at the end of a rack keeps every other name.
    """
    number, tops = 0, []
    for i, racks in enumerate(regions):
        inner = []
        for j, weights in enumerate(racks):
            leaves = []
            for k, weight in enumerate(weights):
                leaves.append(Node(f"r{i}/k{j}/s{k}", shard=number, own=weight))
                number += 1
            inner.append(Node(f"r{i}/k{j}", tuple(leaves)))
        tops.append(Node(f"r{i}", tuple(inner)))
    root = Node("", tuple(tops))
    if not root.weight > 0:
        raise ValueError("a tree needs a shard with a weight")
    return root


def _uniform(name: str, key: Column) -> Column:
    """52 hash bits of (node, key) as a number strictly between 0 and 1."""
    digits = F.substring(F.md5(F.concat(F.lit(name + "|"), key)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def place(node: Node, key: Column) -> Column:
    """The shard number that a row with this string key descends to. A weight of 0 never wins."""
    if not node.children:
        return F.lit(node.shard)
    children = [c for c in node.children if c.weight > 0]
    if len(children) == 1:
        return place(children[0], key)
    draws = [F.log(_uniform(c.name, key)) / F.lit(c.weight) for c in children]
    best = F.greatest(*draws)
    chosen = place(children[-1], key)
    for child, draw in reversed(list(zip(children[:-1], draws[:-1]))):
        chosen = F.when(draw == best, place(child, key)).otherwise(chosen)
    return chosen


def key_text(column: Column) -> Column:
    """The key as text; a null key is one more key of its own."""
    return F.coalesce(column.cast("string"), F.lit("\x00null"))


def shard_rows(
    rows: DataFrame, key: str, before: Node, after: Node | None = None, order_by: Sequence[str] = ()
) -> DataFrame:
    """Add ``shard``, ``slot`` (0, 1, ... without gaps in each shard) and ``grown_shard``.

    Rows of a shard are numbered by key hash, key and ``order_by``; rows equal in all of
    these are interchangeable. The numbering runs per slice of the hash (a slice is a hash
    prefix, as long as the session's shuffle is wide, which doesn't change the numbers) and
    adds the size of the earlier slices, at most shards x slices small rows. Null and
    repeated keys, empty tables and extra columns of any name are kept; a clash with one of
    the three new names raises.
    """
    clash = {"shard", "slot", "grown_shard"} & {c.lower() for c in rows.columns}
    if clash:
        raise ValueError(f"the rows already have {sorted(clash)}")
    digits = max(1, math.ceil(math.log(shuffle_width(rows.sparkSession), 16)))
    text = key_text(quoted(key))
    mark, cut = fresh(rows.columns, "_mark"), fresh(rows.columns, "_slice")
    near, base = fresh(rows.columns, "_near"), fresh(rows.columns, "_base")

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumns({"shard": place(before, text), cut: F.substring(F.md5(text), 1, digits)})

    earlier = Window.partitionBy("shard").orderBy(cut).rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        placed(rows.select(quoted(key)))
        .groupBy("shard", cut)
        .agg(F.count(F.lit(1)).alias(near))
        .select("shard", cut, F.coalesce(F.sum(near).over(earlier), F.lit(0)).alias(base))
    )
    numbers = Window.partitionBy("shard", cut).orderBy(mark, quoted(key), *map(quoted, order_by))
    return (
        placed(rows)
        .withColumns(
            {
                mark: F.md5(text),
                "grown_shard": place(after, text) if after else F.lit(None).cast("int"),
            }
        )
        .withColumn(near, F.row_number().over(numbers))
        .join(bases, ["shard", cut])
        .select(
            *[quoted(c) for c in rows.columns],
            "shard",
            (F.col(base) + F.col(near) - 1).cast("long").alias("slot"),
            "grown_shard",
        )
    )


#: Two regions of two racks with two shards each; the grown tree has one more region with one shard.
EIGHT = [[[1.0, 1.0], [1.0, 1.0]], [[1.0, 1.0], [1.0, 1.0]]]
NINE = [*EIGHT, [[1.0]]]


def _place_sql(node: Node) -> str:
    children = [c for c in node.children if c.weight > 0]
    if not node.children:
        return str(node.shard)
    if len(children) == 1:
        return _place_sql(children[0])
    draws = [
        f"(ln((CAST(CAST('0x' || substr(md5('{c.name}|' || k), 1, 13) AS BIGINT) AS DOUBLE) + 0.5)"
        f" / 4503599627370496.0) / {c.weight})"
        for c in children
    ]
    best = f"greatest({', '.join(draws)})"
    cases = " ".join(f"WHEN {d} = {best} THEN {_place_sql(c)}" for c, d in zip(children[:-1], draws))
    return f"CASE {cases} ELSE {_place_sql(children[-1])} END"


#: The generator of the CRC-32 checksum, reflected; its table of 256 follows from the rule below.
_CRC = 0xEDB88320
_CRC_SQL = f"""crc_bits AS (
  SELECT list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, {_CRC}) ELSE c // 2 END) AS v, i
  FROM range(256) t(i)),
crc AS (SELECT list(v ORDER BY i) AS t FROM crc_bits)"""


def crc_sql(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of a text column, beside a CTE ``crc``."""
    return (
        f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all("
        f"hex(encode({text})), '..'), lambda b: CAST('0x' || b AS BIGINT))),"
        f" lambda c, b: xor(c // 256, crc.t[xor(c % 256, b) + 1])), 4294967295)"
    )


OP1_SQL = f"""WITH {_CRC_SQL},
d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), chr(0) || 'null') AS k,
  coalesce(text, '') AS text FROM documents),
s AS (SELECT doc_id, md5(k) AS mark, CAST(strlen(text) + 1 AS BIGINT) AS size,
  {crc_sql("text")} AS text_crc32,
  CAST({_place_sql(tree(EIGHT))} AS INTEGER) AS shard,
  CAST({_place_sql(tree(NINE))} AS INTEGER) AS grown_shard FROM d, crc)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY mark, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
  grown_shard FROM s"""


@query(sql=OP1_SQL)
def op1_hash_tree(spark, sf_dir):
    """All documents in shards 0 to 7 under the law ``key``; a null text has size 1 and checksum 0."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = shard_rows(docs, "doc_id", tree(EIGHT), tree(NINE), ["size", "text_crc32"])
    return placed.withColumn("law", F.lit("key"))
