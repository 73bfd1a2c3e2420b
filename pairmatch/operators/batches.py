"""Training batches as tables: hard replay, mixing, order swaps and batch ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairmatch.functions.hashing import hash_slot, seeded_hash, unit_interval
from pairmatch.operators.ranking import ordinal, running_sums
from pairmatch.session import shuffle_width, task_count


def swap_pairs(
    df: DataFrame,
    probability: float,
    seed: int,
    canonical_text: bool = False,
    left: str = "left_",
    right: str = "right_",
) -> DataFrame:
    """Swap the two sides of a hashed share of the pairs."""
    if not 0.0 <= probability <= 1.0:
        raise ValueError("the swap probability must be in [0, 1]")
    if canonical_text and probability:
        raise ValueError("canonical pair text has no order to swap")
    if not probability:
        return df.withColumn("swapped", F.lit(False))
    drawn = df.withColumn(
        "swapped", unit_interval(seeded_hash(seed, "id1", "id2")) < F.lit(probability)
    )
    partner = {"id1": "id2", "id2": "id1"}
    for name in df.columns:
        if name.startswith(left) and right + name[len(left):] in df.columns:
            other = right + name[len(left):]
            partner[name], partner[other] = other, name
    return drawn.select(
        *[
            F.when(F.col("swapped"), F.col(partner[c])).otherwise(F.col(c)).alias(c)
            if c in partner
            else F.col(c)
            for c in df.columns
        ],
        "swapped",
    )


def read_chunks(
    df: DataFrame, chunk_rows: int, seed: int, keys: tuple[str, ...] = ("id1", "id2")
) -> DataFrame:
    """Deal shuffled rows into chunks of exactly ``chunk_rows``; the last may be short.

    Rows are counted first: the more there are, the more tasks the slots and the chunks are
    dealt to, so that no task sorts more rows as the table grows. Settle ``df`` before.
    """
    if chunk_rows < 1:
        raise ValueError("chunk_rows must be positive")
    width = shuffle_width(df.sparkSession)
    tasks = task_count(df.sparkSession, df.count())
    grown = tasks > width
    hashed = df.withColumn("_hash", seeded_hash(seed, *keys))
    numbered = ordinal(
        hashed,
        [],
        [F.col("_hash"), *[F.col(k) for k in keys]],
        "_at",
        # Several slots to a task even out how many a hash of them gives it.
        slot=hash_slot(F.col("_hash"), 8 * tasks if grown else width),
        slots=tasks if grown else None,
    )
    chunked = numbered.select(
        *df.columns, F.floor((F.col("_at") - 1) / F.lit(chunk_rows)).alias("chunk")
    )
    # All windows over chunks read them as they are dealt here.
    return chunked.repartition(tasks, "chunk") if grown else chunked


def _half_even(value: Column) -> Column:
    return F.bround(value, 0).cast("bigint")


def hard_replay(
    chunked: DataFrame,
    fraction: float,
    seed: int,
    negative_target_max: float = 0.2,
    positive_target_min: float = 0.8,
) -> DataFrame:
    """Replace a fixed share of every chunk by hard and easy training pairs.

    Needs ``chunk``, the thresholds of the row's category, ``surface_similarity`` and
    ``identity_conflicts``. Half the replay rows are hard (split between negatives and
    positives), half easy negatives; a class too small for its share repeats rows, a
    missing class is made up from the rest of the chunk, and a chunk without hard rows is
    left alone. Every chunk keeps its row count. Chunks have a fixed size, so their
    windows are bounded. Adds ``source`` (base or the replayed class) and ``copy``.
    """
    if not 0.0 <= fraction < 1.0:
        raise ValueError("the replay fraction must be in [0, 1)")
    target, similar = F.col("target"), F.col("surface_similarity")
    negative = target <= negative_target_max
    near = similar >= F.col("hard_negative_min_similarity")
    kind = (
        F.when(negative & (near | (F.col("identity_conflicts") > 0)), F.lit("hard_negative"))
        .when(
            (target >= positive_target_min) & (similar <= F.col("hard_positive_max_similarity")),
            F.lit("hard_positive"),
        )
        .when(negative, F.lit("easy_negative"))
        .otherwise(F.lit("other"))
    )
    chunk = Window.partitionBy("chunk")
    counted = (
        chunked.withColumn("_kind", kind)
        .withColumn("_n", F.count(F.lit(1)).over(chunk))
        .withColumn("_hn", F.count_if(F.col("_kind") == "hard_negative").over(chunk))
        .withColumn("_hp", F.count_if(F.col("_kind") == "hard_positive").over(chunk))
        .withColumn("_en", F.count_if(F.col("_kind") == "easy_negative").over(chunk))
    )
    wanted = F.least(
        F.col("_n") - 1, F.greatest(F.lit(1), _half_even(F.col("_n") * F.lit(fraction)))
    )
    replay = F.when((F.col("_hn") + F.col("_hp") == 0) | F.lit(fraction == 0.0), F.lit(0)).otherwise(wanted)
    sized = counted.withColumn("_replay", replay.cast("bigint")).withColumn(
        "_hard", F.floor((F.col("_replay") + 1) / 2)
    )
    share = (
        sized.withColumn(
            "_want_hn",
            F.when(F.col("_hn") == 0, 0)
            .when(F.col("_hp") == 0, F.col("_hard"))
            .otherwise(F.floor(F.col("_hard") / 2)),
        )
        .withColumn("_want_hp", F.col("_hard") - F.col("_want_hn"))
        .withColumn("_want_en", F.when(F.col("_en") == 0, 0).otherwise(F.col("_replay") - F.col("_hard")))
    )
    need = (
        F.when(F.col("_kind") == "hard_negative", F.col("_want_hn"))
        .when(F.col("_kind") == "hard_positive", F.col("_want_hp"))
        .when(F.col("_kind") == "easy_negative", F.col("_want_en"))
        .otherwise(0)
    )
    have = F.count(F.lit(1)).over(Window.partitionBy("chunk", "_kind"))

    def drawn(offset: int, *keys: str):
        order = [seeded_hash(seed + offset, "id1", "id2"), F.col("id1"), F.col("id2")]
        return F.row_number().over(Window.partitionBy("chunk", *keys).orderBy(*order))

    classed = (
        share.withColumn("_need", need.cast("bigint"))
        .withColumn("_have", have)
        .withColumn("_at", drawn(1, "_kind"))
        .withColumn(
            # Repeat rows evenly when the class is short: each floor(need / have) times,
            # the first need % have rows once more.
            "_copies",
            F.floor(F.col("_need") / F.col("_have"))
            + F.when(F.col("_at") <= F.col("_need") % F.col("_have"), 1).otherwise(0),
        )
    )
    gap = F.col("_replay") - F.col("_want_hn") - F.col("_want_hp") - F.col("_want_en")
    spare = classed.withColumn("_spare", F.col("_copies") == 0).withColumn(
        "_spare_at", drawn(2, "_spare")
    ).withColumn("_gap", gap)
    rest = F.count_if("_spare").over(chunk)
    filled = spare.withColumn("_rest", rest).withColumn(
        "_fill",
        F.when(
            F.col("_spare"),
            F.floor(F.col("_gap") / F.col("_rest"))
            + F.when(F.col("_spare_at") <= F.col("_gap") % F.col("_rest"), 1).otherwise(0),
        ).otherwise(0),
    )
    base_at = filled.withColumn("_base_at", drawn(3))
    emitted = base_at.withColumn(
        "_base", F.when(F.col("_base_at") <= F.col("_n") - F.col("_replay"), 1).otherwise(0)
    )

    def copies(source: Column, count: Column) -> Column:
        return F.transform(
            F.when(count > 0, F.sequence(F.lit(1), count.cast("int"))).otherwise(
                F.array().cast("array<int>")
            ),
            lambda i: F.struct(source.alias("source"), i.alias("copy")),
        )

    entries = F.concat(
        copies(F.lit("base"), F.col("_base")),
        copies(F.col("_kind"), F.col("_copies")),
        copies(F.lit("fallback"), F.col("_fill")),
    )
    return emitted.select(*chunked.columns, F.inline(entries))


def batch_ids(
    chunked: DataFrame, batch_rows: int, chunk_rows: int, length: Column, seed: int
) -> DataFrame:
    """Exact-size batches of similar text lengths, carried over chunk borders.

    Rows are ordered by length inside their chunk. All chunks but the last hold
    ``chunk_rows`` rows, so a row's global position needs no global window.
    ``batch_order`` shuffles the batches.
    """
    if batch_rows < 1 or chunk_rows < batch_rows:
        raise ValueError("chunk_rows must be at least batch_rows, and that positive")
    repeat = [F.col(c) for c in ("source", "copy") if c in chunked.columns]
    inside = Window.partitionBy("chunk").orderBy(
        length, seeded_hash(seed, "id1", "id2"), "id1", "id2", *repeat
    )
    position = F.col("chunk") * F.lit(chunk_rows) + F.row_number().over(inside) - 1
    placed = chunked.withColumn("_position", position)
    batch = F.floor(F.col("_position") / F.lit(batch_rows))
    return placed.select(
        *chunked.columns,
        batch.alias("batch_id"),
        (F.col("_position") % F.lit(batch_rows)).cast("int").alias("batch_row"),
        seeded_hash(seed, batch).alias("batch_order"),
    )


def carried_batches(
    chunked: DataFrame, batch_rows: int, length: Column, seed: int, keys: tuple[str, ...] = ("id1", "id2")
) -> DataFrame:
    """Exact-size batches of similar lengths over chunks of any size, with what is left handed on.

    A chunk's rows are ordered by length. What the chunks before it left open is filled up with
    its longest rows, its other rows make batches from the shortest on, and the rest waits for
    the next chunk. A batch is always full, so the rows that wait before a chunk are the rows
    before it modulo ``batch_rows``: running totals over the chunks place every row, and no
    chunk has to wait for another. Only the last batch may be short. Adds ``batch_id``,
    ``batch_row`` and ``batch_order``, which shuffles the batches.
    """
    if batch_rows < 1:
        raise ValueError("batch_rows must be positive")
    sizes = chunked.groupBy("chunk").agg(F.count(F.lit(1)).alias("_size"))
    before = running_sums(sizes, [], F.col("chunk"), ["_size"], totals=False).select(
        "chunk", "_size", (F.col("_size_upto") - F.col("_size")).alias("_before")
    )
    repeat = [F.col(c) for c in ("source", "copy") if c in chunked.columns]
    inside = Window.partitionBy("chunk").orderBy(length, seeded_hash(seed, *keys), *keys, *repeat)
    placed = chunked.withColumn("_at", F.row_number().over(inside) - 1).join(before, "chunk")
    # Never more than the chunk has: a chunk too small to fill the open batch goes into it whole.
    needed = F.least(F.pmod(-F.col("_before"), F.lit(batch_rows)), F.col("_size"))
    rest = F.col("_size") - needed
    position = F.col("_before") + F.when(F.col("_at") >= rest, F.col("_at") - rest).otherwise(F.col("_at") + needed)
    numbered = placed.withColumn("_position", position)
    batch = F.floor(F.col("_position") / F.lit(batch_rows))
    return numbered.select(
        *chunked.columns,
        batch.alias("batch_id"),
        (F.col("_position") % F.lit(batch_rows)).cast("int").alias("batch_row"),
        seeded_hash(seed, batch).alias("batch_order"),
    )


def replay_share(rows: Column, fraction: float) -> Column:
    """Replay rows that make up ``fraction`` of a mixed batch, at least one."""
    if not 0.0 < fraction < 0.5:
        raise ValueError("the replay fraction must be in (0, 0.5)")
    return F.greatest(F.lit(1), _half_even(rows * F.lit(fraction) / F.lit(1.0 - fraction)))


def mixed_replay(
    primary: DataFrame, replay: DataFrame, batch_rows: int, fraction: float, seed: int
) -> DataFrame:
    """Every primary row plus the next replay rows, batch by batch.

    Both tables get their position from a seeded shuffle, and a replay row finds its
    batch by division, so no range join is needed. Too little replay fails the job.
    """
    share = replay_share(F.lit(batch_rows), fraction)

    def placed(df: DataFrame, offset: int) -> DataFrame:
        hashed = df.select("id1", "id2", "target", "category").withColumn(
            "_hash", seeded_hash(seed + offset, "id1", "id2")
        )
        return ordinal(
            hashed,
            [],
            [F.col("_hash"), F.col("id1"), F.col("id2")],
            "_at",
            slot=hash_slot(F.col("_hash"), shuffle_width(df.sparkSession)),
        ).drop("_hash")

    first = placed(primary, 0).select(
        "id1", "id2", "target", "category",
        F.floor((F.col("_at") - 1) / F.lit(batch_rows)).alias("batch_id"),
        F.lit("primary").alias("source"),
    )
    size = primary.agg(F.count(F.lit(1)).alias("_n"))
    full = F.floor(F.col("_n") / F.lit(batch_rows))
    last = F.col("_n") % F.lit(batch_rows)
    needs = size.select(
        (full * share + F.when(last > 0, replay_share(last, fraction)).otherwise(0)).alias("_need")
    )
    supply = replay.agg(F.count(F.lit(1)).alias("_have"))
    enough = needs.select(
        F.when(supply.scalar() >= F.col("_need"), F.col("_need")).otherwise(
            F.raise_error(F.lit("the replay table ends before the primary rows")).cast("bigint")
        )
    )
    second = placed(replay, 1).where(F.col("_at") <= enough.scalar()).select(
        "id1", "id2", "target", "category",
        F.floor((F.col("_at") - 1) / share).alias("batch_id"),
        F.lit("replay").alias("source"),
    )
    return first.unionByName(second)
