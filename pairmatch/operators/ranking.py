"""Prefix sums, ranks and row numbers inside groups of any size.

A plain ranking window puts a whole group into one task, so a category that holds a
third of the rows becomes the job's only running task. Here rows are dealt by one range
shuffle on (keys, order), so that a large group spreads over as many tasks as its rows
need and small groups share one. A task runs through its sorted rows once and numbers and
adds them up per group. Of a task's groups only the first can have begun in an earlier
task, so the numbers to add on top are a table of at most two rows per task, whatever the
number of rows, groups or tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairmatch.session import few_rows, publish, settle, shuffle_width

_SLOT = "_slot"
_ORDER = "_order"


def with_required(df: DataFrame, names: Sequence[str], numbers: Sequence[str] = ()) -> DataFrame:
    """Fail the job on a row with a null among ``names``, or a null or NaN among ``numbers``.

    The check is part of the columns themselves, so it costs no pass of its own, and rows
    that a join on these columns would lose can't go unnoticed.
    """
    told = {n: F.col(f"`{n}`").isNull() for n in names}
    for n in numbers:
        value = F.col(f"`{n}`")
        kind = df.schema[n].dataType.typeName()
        told[n] = value.isNull() | F.isnan(value) if kind in ("float", "double") else value.isNull()
    return df.withColumns(
        {
            n: F.when(bad, F.raise_error(F.lit(f"{n} is missing in a ranked row"))).otherwise(F.col(f"`{n}`"))
            for n, bad in told.items()
        }
    )


def _numbered(df: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Add to sorted partitions: ``_part``; ``_head`` for rows of the partition's first group;
    ``_row`` and ``_run_<sum>``, counted and added up per group inside the partition."""
    schema = T.StructType(
        [
            *df.schema.fields,
            T.StructField("_part", T.IntegerType()),
            T.StructField("_head", T.BooleanType()),
            T.StructField("_row", T.LongType()),
            *(T.StructField(f"_run_{s}", T.LongType()) for s in sums),
        ]
    )
    places = [df.columns.index(k) for k in keys]
    added = [df.columns.index(s) for s in sums]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        # Counters of the group that the last batch ended in, and that group's keys.
        group, carried, head = None, [0] * (1 + len(added)), True
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            begins = np.zeros(size, bool)
            for place in places:
                column = batch.column(place)
                after, before = column.slice(1), column.slice(0, size - 1)
                differ = pc.or_(
                    pc.fill_null(pc.not_equal(after, before), False),
                    pc.xor(pc.is_null(after), pc.is_null(before)),
                )
                begins[1:] |= differ.to_numpy(zero_copy_only=False)
            first = [batch.column(p)[0].as_py() for p in places]
            if group is not None and first != group:
                begins[0] = True
            group = [batch.column(p)[size - 1].as_py() for p in places]
            at = np.arange(size)
            start = np.maximum.accumulate(np.where(begins, at, 0))
            # Rows before the first border carry the counters of the batch before on.
            going = np.cumsum(begins) == 0
            columns = [pa.array(np.full(size, part, np.int32)), pa.array(going & head)]
            head = head and bool(going[-1])
            for k, place in enumerate([None, *added]):
                value = np.ones(size, np.int64) if place is None else batch.column(place).to_numpy(zero_copy_only=False)
                ran = np.cumsum(value)
                ran = ran - (ran - value)[start] + np.where(going, carried[k], 0)
                carried[k] = int(ran[-1])
                columns.append(pa.array(ran))
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.names)

    return df.mapInArrow(run, schema)


def range_sorted(df: DataFrame, keys: Sequence[str], order: Sequence[str], slots: int | None = None) -> DataFrame:
    """``df`` dealt by ranges of (keys, order) and sorted in them, with the partition's ``_part``.

    The borders come from a sample: settle or publish the result before it is read twice.
    """
    by = [F.col(f"`{c}`") for c in (*keys, *order)]
    # A number of ranges is given, or adaptive execution would join ranges up to its advisory size.
    dealt = df.repartitionByRange(slots or shuffle_width(df.sparkSession), *by)
    return dealt.sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id())


def _same(left: str, right: str, keys: Sequence[str]) -> Column:
    """Equal keys of two aliased tables, nulls equal to each other."""
    met = F.lit(True)
    for k in keys:
        met = met & F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`"))
    return met


def _ranged(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: Sequence[str] = (), slots: int | None = None
) -> DataFrame:
    """``df`` with ``_number`` (from 1) and ``_upto_<sum>`` per group, ascending by ``order``.

    The numbered rows are published: the partitions' borders come from a sample, so rows
    that were dealt twice could be dealt differently. Sums are of whole numbers.
    """
    names = [f"{_ORDER}{i}" for i in range(len(order))]
    dealt = range_sorted(df.withColumns(dict(zip(names, order))), keys, names, slots)
    rows = publish(_numbered(dealt.drop(*names, "_part"), keys, sums))
    # The groups that may run over a border, one per partition, and their sizes there.
    spread = rows
    if keys:
        heads = rows.where("_head").select(*keys).distinct()
        spread = rows.alias("r").join(heads.alias("h"), _same("r", "h", keys), "left_semi")
    cells = spread.groupBy(*keys, "_part").agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(s).alias(f"_sum_{s}") for s in sums]
    )
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(
        *keys,
        "_part",
        F.sum("_rows").over(before).alias("_before"),
        *[F.sum(f"_sum_{s}").over(before).alias(f"_before_{s}") for s in sums],
    ).where("_before is not null")
    met = (F.col("r._part") == F.col("o._part")) & _same("r", "o", keys)
    return (
        rows.alias("r")
        .join(offsets.alias("o"), met, "left")
        .select(
            *[F.col(f"r.`{c}`") for c in df.columns],
            (F.col("_row") + F.coalesce("_before", F.lit(0))).alias("_number"),
            *[(F.col(f"_run_{s}") + F.coalesce(f"_before_{s}", F.lit(0))).alias(f"_upto_{s}") for s in sums],
        )
    )


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Column,
    sums: Sequence[str],
    slots: int | None = None,
    totals: bool = True,
) -> DataFrame:
    """Add ``<name>_upto`` (inclusive, ascending ``order``) and ``<name>_total`` per group.

    Rows must be unique per (group, order); pre-aggregate first. Sums are of whole numbers;
    ``totals=False`` leaves the totals out. ``slots`` is the number of ranges, the session's
    shuffle width by default.
    """
    ran = _ranged(df, keys, [order], sums, slots).select(
        *[f"`{c}`" for c in df.columns], *[F.col(f"_upto_{s}").alias(f"{s}_upto") for s in sums]
    )
    if not totals:
        return ran
    whole = ran.groupBy(*keys).agg(*[F.sum(s).alias(f"{s}_total") for s in sums])
    if not keys:
        return ran.select("*", *[whole.select(f"{s}_total").scalar().alias(f"{s}_total") for s in sums])
    return (
        ran.alias("r")
        .join(whole.alias("t"), _same("r", "t", keys))
        .select("r.*", *[f"t.{s}_total" for s in sums])
    )


def ordinal(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    out: str,
    slot: Column | None = None,
    slots: int | None = None,
) -> DataFrame:
    """Row number from 1 per group, ascending by ``order``; negate numbers to descend.

    The last order columns have to break every tie (a hash and the pair ids do). Pass
    ``slot`` when the order starts with a uniform hash: its leading bits already cut a
    group into even ranges, and nothing is sampled or published. ``slots`` is then the number of
    tasks they are dealt to.
    """
    if slot is None:
        # Rows without a key are a group until they are read: the reader's job fails.
        return with_required(_ranged(df, keys, order, (), slots), keys).select(
            *[f"`{c}`" for c in df.columns], F.col("_number").cast("bigint").alias(out)
        )
    prepared = with_required(df, keys)
    slotted = prepared.withColumn(_ORDER, F.struct(*order)).withColumn(_SLOT, slot)
    if slots:
        slotted = slotted.repartition(slots, *[F.col(f"`{k}`") for k in keys], _SLOT)
    totals = slotted.groupBy(*keys, _SLOT).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = (
        Window.partitionBy(*keys).orderBy(_SLOT).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *keys, _SLOT, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before")
    )
    local = Window.partitionBy(*keys, _SLOT).orderBy(_ORDER)
    numbered = slotted.withColumn("_local", F.row_number().over(local))
    return numbered.join(offsets, [*keys, _SLOT]).select(
        *df.columns, (F.col("_before") + F.col("_local")).cast("bigint").alias(out)
    )


#: Shares of a group whose values are tried as its cut, and the accuracy of the sketch they come from.
_SHARES = tuple(min(1.0, 0.0002 * 1.3**i) for i in range(34))
_ACCURACY = 10_000


def _leading_numbers(order: Sequence[Column], df: DataFrame) -> list[Column]:
    """The leading order columns as doubles that never fall where the column rises."""
    out = []
    for column, field in zip(order, df.select(*order).schema.fields):
        if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            out.append(F.when(F.isnan(column), F.lit(float("inf"))).otherwise(column.cast("double")))
        elif isinstance(field.dataType, (T.IntegralType, T.DecimalType, T.BooleanType)):
            out.append(column.cast("double"))
        else:
            break
    return out


def _under(cuts: Sequence[str], names: Sequence[str]) -> Column:
    """Rows up to the cut, compared letter by letter; a null cut cuts nothing, null values come first."""
    fits = F.lit(True)
    for cut, name in reversed(list(zip(cuts, names))):
        value, limit = F.col(name), F.col(cut)
        fits = limit.isNull() | value.isNull() | (value < limit) | ((value == limit) & fits)
    return fits


def _cuts(narrow: DataFrame, keys: Sequence[str], names: Sequence[str], quotas: DataFrame) -> tuple[DataFrame, list[str]]:
    """``keys, quota`` and a cut per order column: at least ``quota`` rows of the group lie under it.

    A sketch of the leading column per group gives a value just above the quota, and a count
    tells how many rows that keeps. Where equal values keep far more than asked for, the next
    column cuts among those. A sketch that kept too few is no cut.
    """
    bounds = settle(quotas.select(*keys, "quota", F.col("quota").alias("_rest"), F.lit(True).alias("_loose")))
    shares = F.array(*[F.lit(x) for x in _SHARES])
    cuts: list[str] = []
    for level, name in enumerate(names):
        tied = narrow.join(few_rows(bounds), list(keys)).where("_loose")
        for cut, own in zip(cuts, names):
            tied = tied.where(F.col(own) == F.col(cut))
        tried = F.arrays_zip(shares.alias("share"), F.col("_values").alias("value"))
        least = F.greatest(F.col("_rest"), F.lit(1)) / F.col("_n") + F.lit(2.0 / _ACCURACY)
        found = (
            tied.groupBy(*keys, "_rest")
            .agg(F.count(name).alias("_n"), F.percentile_approx(name, list(_SHARES), _ACCURACY).alias("_values"))
            .select(*keys, F.get(F.filter(tried, lambda z: z["share"] >= least), F.lit(0))["value"].alias("_found"))
        )
        cuts.append(f"_cut{level}")
        bounds = settle(bounds.join(found, list(keys), "left").withColumnRenamed("_found", cuts[-1]))
        last, own = F.col(cuts[-1]), F.col(name)
        equal = F.lit(True)
        for cut, other in zip(cuts[:-1], names):
            equal = equal & F.col(other).eqNullSafe(F.col(cut))
        counted = (
            narrow.join(few_rows(bounds), list(keys))
            .groupBy(*keys)
            .agg(
                F.count(F.lit(1)).alias("_rows"),
                F.count_if(_under(cuts, names)).alias("_kept"),
                F.count_if(equal & (own == last)).alias("_ties"),
            )
        )
        short = F.col("_kept") < F.least(F.col("quota"), F.col("_rows"))
        slack = F.col("quota") * 2 + F.col("_rows") / 500
        bounds = settle(
            bounds.join(counted, list(keys), "left").select(
                *keys,
                "quota",
                *cuts[:-1],
                F.when(short, F.lit(None)).otherwise(last).alias(cuts[-1]),
                # What the ties at the cut have to give: all that the rows before them don't.
                (F.col("quota") - F.col("_kept") + F.col("_ties")).alias("_rest"),
                (F.col("_loose") & ~short & last.isNotNull() & (F.col("_kept") > slack)).alias("_loose"),
            )
        )
        if level + 1 == len(names) or bounds.where("_loose").isEmpty():
            break
    return bounds.drop("_rest", "_loose"), cuts


def first_rows(
    df: DataFrame, keys: Sequence[str], quotas: DataFrame, order: Sequence[Column], out: str
) -> DataFrame:
    """The first ``quota`` rows of every group of ``quotas(keys, quota)``, numbered from 1 as ``out``.

    Only the order columns are read to find a cut for every group; the rows under the cuts,
    little more than asked for, are the ones that are shuffled and sorted. Groups without a
    quota have no rows; a null key fails the job; order columns must break every tie.
    """
    # Rows without a key would get lost in the joins on it.
    df = with_required(df, keys)
    numbers = _leading_numbers(order, df)
    if not numbers:
        every = ordinal(df.join(quotas.select(*keys, "quota"), list(keys)), keys, order, out)
        return every.where(F.col(out) <= F.col("quota")).select(*[f"`{c}`" for c in df.columns], out)
    names = [f"{_ORDER}{i}" for i in range(len(numbers))]
    narrow = publish(df.select(*keys, *[c.alias(n) for c, n in zip(numbers, names)]))
    bounds, cuts = _cuts(narrow, keys, names, quotas)
    kept = df.withColumns(dict(zip(names, numbers))).join(few_rows(bounds), list(keys)).where(_under(cuts, names))
    kept = publish(kept.select(*[f"`{c}`" for c in df.columns], "quota"))
    numbered = ordinal(kept, keys, order, out).where(F.col(out) <= F.col("quota"))
    return numbered.select(*[f"`{c}`" for c in df.columns], out)


def rank_table(
    df: DataFrame, keys: Sequence[str], value: str, rank: str, rows: str | None = None
) -> DataFrame:
    """``keys, value`` with the average-method rank, one row per distinct value.

    Heavy ties collapse before anything is ranked. A null key, and a null or NaN value, fail.
    """
    df = with_required(df, keys, [value])
    cells = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return running_sums(cells, keys, F.col(value), ["_n"]).select(
        *keys,
        value,
        (F.col("_n_upto") - F.col("_n") + (F.col("_n") + 1) / F.lit(2.0)).alias(rank),
        *([F.col("_n_total").alias(rows)] if rows else []),
    )


def average_ranks(
    df: DataFrame, keys: Sequence[str], value: str, rank: str, rows: str | None = None
) -> DataFrame:
    """Add the average-method rank of ``value`` in its group, and the group size."""
    return df.join(rank_table(df, keys, value, rank, rows), [*keys, value])


def percentile_ranks(
    df: DataFrame, keys: Sequence[str], outs: Mapping[str, str], zero_one: bool = False
) -> DataFrame:
    """``rank / (n + 1)``, or ``(rank - 1) / max(n - 1, 1)`` when ``zero_one``.

    ``outs`` maps value columns to rank columns. All rank tables come straight from
    ``df``: ranking a table that already carries a rank join would redo that join.
    """
    ranked = df
    for value, out in outs.items():
        table = rank_table(df, keys, value, "_rank", "_size")
        if zero_one:
            share = (F.col("_rank") - 1) / F.greatest(F.col("_size") - 1, F.lit(1))
        else:
            share = F.col("_rank") / (F.col("_size") + F.lit(1.0))
        ranked = ranked.join(table.select(*keys, value, share.alias(out)), [*keys, value])
    return ranked.select(*df.columns, *outs.values())


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    parts: Mapping[str, tuple[Column, float]],
    counts: Mapping[str, str],
) -> DataFrame:
    """``keys`` with an exact quantile per part, and the part's rows under its name in ``counts``.

    A part is a row mask and a share; between two values the quantile is linear. It is found as
    an order statistic: running counts over the distinct values, dealt by ranges, tell which
    values the two ranks beside it fall on, so no task holds a group. Null values count as rows only.
    """
    shares = {name: share for name, (_, share) in parts.items()}
    masks = df.select(
        *keys, F.col(value).alias("_value"), *[F.coalesce(m, F.lit(False)).alias(f"_in_{n}") for n, (m, _) in parts.items()]
    )
    cells = masks.groupBy(*keys, "_value").agg(
        *[F.count_if(f"_in_{n}").alias(f"_all_{n}") for n in parts],
        *[F.count_if(F.col(f"_in_{n}") & F.col("_value").isNotNull()).alias(f"_n_{n}") for n in parts],
    )
    ran = running_sums(cells, keys, F.col("_value"), [f"_n_{n}" for n in parts])

    def at(name: str, place: Column) -> Column:
        """The value whose rows cover the place, counted from 0."""
        upto = F.col(f"_n_{name}_upto")
        return F.max(F.when((upto - F.col(f"_n_{name}") <= place) & (place < upto), F.col("_value")))

    def position(name: str) -> Column:
        return (F.col(f"_n_{name}_total") - 1) * F.lit(shares[name])

    found = ran.groupBy(*keys).agg(
        *[at(n, F.floor(position(n))).alias(f"_low_{n}") for n in parts],
        *[at(n, F.ceil(position(n))).alias(f"_high_{n}") for n in parts],
        *[F.max(position(n) - F.floor(position(n))).alias(f"_part_{n}") for n in parts],
        *[F.sum(f"_all_{n}").alias(counts[n]) for n in parts],
    )
    between = [
        (F.col(f"_low_{n}") + (F.col(f"_high_{n}") - F.col(f"_low_{n}")) * F.col(f"_part_{n}")).alias(n) for n in parts
    ]
    return found.select(*keys, *between, *[counts[n] for n in parts])
