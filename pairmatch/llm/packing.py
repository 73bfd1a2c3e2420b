"""Packing by minimum bin slack: fill each window with the remaining lengths that fit it best.

A document's ids are cut into whole windows and one remainder. For the remainders, a window
takes the longest one left and then the multiset of others whose sum comes closest to the
capacity: a bitset holds every reachable sum, one shift per length and binary count, and the
counts are read back from the bitsets kept on the way. A filling is used as often as its
lengths last, so the work depends on the number of distinct lengths, not of documents.

Each task packs exact fillings from its own remainders as they come. What finds no exact
filling there is packed from one histogram of lengths over the whole corpus (at most one
number per length below the window), so the result is as tight for many small partitions as
for one large one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairmatch.llm.bpe import byte_symbols, tokenizer_path
from pairmatch.llm.common import publish, query, quoted, table

#: Sequence numbers of a task start at (task + 1) times this; the corpus-wide ones lie below it.
TASK_STEP = 1 << 40


def fill(counts: dict[int, int], first: int, capacity: int) -> dict[int, int]:
    """Multiset of lengths, one ``first`` included, whose sum is closest below the capacity.

    ``counts`` are the lengths left, ``first`` among them.
    """
    room = capacity - first
    mask, sums = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted(counts, reverse=True):
        if sums >> room & 1:
            break
        copies = min(counts[length] - (length == first), room // length)
        part = 1
        while copies > 0:
            part = min(part, copies)
            more = sums | (sums << (length * part)) & mask
            if more != sums:
                steps.append((length, part, sums))
                sums = more
            copies -= part
            part *= 2
    target, taken = sums.bit_length() - 1, {first: 1}
    for length, part, earlier in reversed(steps):
        if not earlier >> target & 1:
            taken[length] = taken.get(length, 0) + part
            target -= length * part
    return taken


def fillings(counts: dict[int, int], capacity: int, exact: bool = False) -> list[tuple[dict[int, int], int]]:
    """(multiset, how many windows) until nothing is left; with ``exact`` only full windows,
    and ``counts`` keeps what found none."""
    out, put_aside = [], {}
    while counts:
        first = max(counts)
        taken = fill(counts, first, capacity)
        if exact and sum(n * m for n, m in taken.items()) < capacity:
            put_aside[first] = counts.pop(first)
            continue
        times = min(counts[length] // n for length, n in taken.items())
        out.append((taken, times))
        for length, n in taken.items():
            counts[length] -= n * times
            if not counts[length]:
                del counts[length]
    counts.update(put_aside)
    return out


def _encoder(path: str):
    """Text to ids for a byte-level BPE file, its special tokens included."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    byte = {c: b for b, c in enumerate(byte_symbols())}
    ranks = {bytes([byte[c] for c in token]): n for token, n in parts["model"]["vocab"].items()
             if all(c in byte for c in token)}
    special = {t["content"]: t["id"] for t in parts["added_tokens"]}
    for content in special:
        ranks.pop(content.encode(), None)
    import public_tokenizers

    made = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    allowed, slower = set(special), []

    def encode(text: str) -> list[int]:
        try:
            return made.encode(text, allowed_special=allowed, disallowed_special=())
        except ValueError:
            # Very long runs of white space exceed the splitter's stack; the other library takes them.
            if not slower:
                from tokenizers import Tokenizer

                slower.append(Tokenizer.from_file(path))
                slower[0].no_truncation()
                slower[0].no_padding()
            return slower[0].encode(text, add_special_tokens=False).ids

    return encode


def pack(
    docs: DataFrame,
    key: str,
    text: str,
    path: str,
    capacity: int = 1024,
    end_id: int = 0,
    pool: int = 20_000,
) -> DataFrame:
    """Pieces of every document in windows of at most ``capacity`` ids.

    Returns ``key, start, length, ids, doc_tokens, sequence_id, offset``: ``ids`` are the
    piece's ids as little-endian unsigned 32-bit integers, ``start`` counts the document's
    ids before it. Each document is its ids and ``end_id``; a null text is read as empty and
    gives the end id alone. Repeated rows and null keys are documents of their own; an empty
    table gives no pieces; other columns are not read, so none can clash. ``pool`` bounds
    the remainders that one task holds back in search of exact fillings; beyond it they are
    handed to the corpus-wide packing, never dropped.
    """
    if capacity < 1:
        raise ValueError("a window holds at least one id")
    schema = T.StructType(
        [
            T.StructField("key", docs.schema[key].dataType),
            *[T.StructField(n, T.LongType()) for n in ("start", "length")],
            T.StructField("ids", T.BinaryType()),
            *[T.StructField(n, T.LongType()) for n in ("doc_tokens", "sequence_id", "offset", "task", "nth")],
        ]
    )

    def cut(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encode, task = _encoder(path), TaskContext.get().partitionId()
        kinds = None
        waiting: dict[int, list[tuple]] = {}
        sent: dict[int, int] = {}
        sequence = (task + 1) * TASK_STEP
        rows: list[tuple] = []

        def settle_full() -> None:
            nonlocal sequence
            for taken, times in fillings({n: len(w) for n, w in waiting.items()}, capacity, exact=True):
                for _ in range(times):
                    offset = 0
                    for length, n in taken.items():
                        for _ in range(n):
                            rows.append((*waiting[length].pop(), sequence, offset, task, None))
                            offset += length
                        if not waiting[length]:
                            del waiting[length]
                    sequence += 1

        def hand_on() -> None:
            for length in sorted(waiting):
                for piece in waiting[length]:
                    nth = sent.get(length, 0)
                    sent[length] = nth + 1
                    rows.append((*piece, None, None, task, nth))
            waiting.clear()

        def out():
            columns = list(zip(*rows)) or [()] * len(kinds)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=schema.names
            )

        for batch in batches:
            number = pa.int64()
            kinds = [batch.schema.field(0).type, number, number, pa.binary(), *[number] * 5]
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                for name, value in zip(part.column(0).to_pylist(), part.column(1)):
                    ids = np.array([*encode(value.as_py() or ""), end_id], "<u4")
                    size = len(ids)
                    for start in range(0, size, capacity):
                        length = min(capacity, size - start)
                        piece = (name, start, length, ids[start : start + length].tobytes(), size)
                        if length == capacity:
                            rows.append((*piece, sequence, 0, task, None))
                            sequence += 1
                        else:
                            waiting.setdefault(length, []).append(piece)
                settle_full()
                if sum(map(len, waiting.values())) > pool:
                    hand_on()
                yield out()
                rows.clear()
        if waiting:
            hand_on()
            yield out()

    pieces = publish(docs.select(quoted(key).alias("key"), quoted(text).alias("text")).mapInArrow(cut, schema))
    settled, left = pieces.where("sequence_id is not null"), pieces.where("sequence_id is null")
    per_task = left.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    lengths = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places, sequence, used = [], 0, dict.fromkeys(lengths, 0)
    for taken, times in fillings(lengths, capacity):
        offset = 0
        for length, n in taken.items():
            places.append((length, used[length], used[length] + n * times, n, sequence, offset))
            used[length] += n * times
            offset += n * length
        sequence += times
    spark = docs.sparkSession
    # At most a few rows per length and filling: bounded by the capacity, not by the corpus.
    places = spark.createDataFrame(
        places, "length long, low long, high long, each long, sequence long, base long"
    )
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shift = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    at = F.col("shift") + F.col("nth")
    inside = F.col("number") - F.col("low")
    placed = (
        left.drop("sequence_id", "offset")
        .join(shift, ["length", "task"])
        .withColumn("number", at)
        .join(places, "length")
        .where("number >= low and number < high")
        .withColumn("sequence_id", F.col("sequence") + F.floor(inside / F.col("each")))
        .withColumn("offset", F.col("base") + F.pmod(inside, F.col("each")) * F.col("length"))
    )
    names = ["key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    return settled.select(names).unionByName(placed.select(names)).withColumnRenamed("key", key)


@query()
def op7_bin_slack(spark, sf_dir):
    """All documents in sequences of at most 1024 ids, one row per piece."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = pack(docs, "doc_id", "text", tokenizer_path("byte_bpe_50k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
