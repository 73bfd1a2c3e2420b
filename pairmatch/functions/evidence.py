"""Identity evidence between the two items of a pair."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmatch import fixed_values as fixed
from pairmatch.functions.attributes import budgeted_lines, with_attributes
from pairmatch.functions.text import (
    title_identifiers,
    with_comparison_values,
    with_normalized,
)
from pairmatch.session import spread

Groups = Mapping[str, Sequence[str]]


def _group_index(key: Column, groups: Groups) -> Column:
    index = F.lit(-1)
    for position, fragments in reversed(list(enumerate(groups.values()))):
        found = reduce(or_, [key.contains(fragment) for fragment in fragments])
        index = F.when(found, F.lit(position)).otherwise(index)
    return index


def _identity(grouped: Column, groups: Groups) -> Column:
    """Per group: all distinct whole comparison values in order."""

    def values_of(position: int) -> Column:
        mine = F.filter(grouped, lambda e: (e.group == position) & (e.value != ""))
        return F.array_sort(F.array_distinct(F.transform(mine, lambda e: e.value)))

    return F.array(*[values_of(position) for position in range(len(groups))])


def item_cards(
    items: DataFrame,
    groups: Groups = fixed.IDENTITY_GROUPS,
    budget: int = fixed.ATTRIBUTE_BUDGET,
    title_characters: int | None = None,
    value_characters: int | None = None,
    parsed_too: bool = False,
) -> DataFrame:
    """Everything a pair needs from one item, derived once per item before any join.

    Adds ``title, state, lines, sort_key, identity`` and ``title_ids``; with ``parsed_too``
    also ``normal_name`` and ``entries``, so that no one parses the item again. Titles, attribute
    values and identity values are whole unless a limit is given; ``budget`` bounds the
    attribute lines of the model text alone.
    """
    name = F.col("_name")
    title = F.when(name == "", F.lit(fixed.MISSING_MARK)).otherwise(name)
    if title_characters is not None:
        title = F.left(title, F.lit(title_characters))
    named = with_normalized(spread(items), {"_name": F.col("name")})
    parsed = with_attributes(
        named, F.col("attributes"), "_state", "_attributes", value_characters=value_characters
    )
    marked = parsed.withColumn(
        "_marked",
        F.filter(
            F.transform(
                "_attributes",
                lambda e: F.struct(
                    _group_index(e.key, groups).alias("group"), e.value.alias("value")
                ),
            ),
            lambda e: e.group >= 0,
        ),
    )
    compared = with_comparison_values(
        marked, "_compared", F.transform("_marked", lambda e: e.value)
    ).withColumn(
        "_grouped",
        F.zip_with(
            "_marked",
            "_compared",
            lambda e, v: F.struct(e.group.alias("group"), v.alias("value")),
        ),
    )
    carded = compared.select(
        *items.columns,
        title.alias("title"),
        F.col("_state").alias("state"),
        budgeted_lines(F.col("_attributes"), " [VALUE] ", budget).alias("lines"),
        _identity(F.col("_grouped"), groups).alias("identity"),
        title_identifiers(F.col("_name")).alias("title_ids"),
        *([F.col("_name").alias("normal_name"), F.col("_attributes").alias("entries")] if parsed_too else []),
    )
    return carded.withColumn(
        "sort_key",
        F.array_join(F.concat(F.array("title", "state"), F.col("lines")), "\n"),
    )


CARD_FIELDS = ("title", "state", "lines", "sort_key", "identity", "title_ids")


def _conflict(left: Column, right: Column) -> Column:
    a, b = F.array_join(left, "|"), F.array_join(right, "|")
    return F.concat(F.least(a, b), F.lit("<>"), F.greatest(a, b))


def _compare(name: Column, left: Column, right: Column, shown: int | None) -> Column:
    """``struct(match, conflict, missing)`` of two value sets, null where not the case.

    The verdict reads the whole sets; ``shown`` bounds the shared values listed.
    """
    shared = F.array_sort(F.array_intersect(left, right))
    both = (F.size(left) > 0) & (F.size(right) > 0)
    either = (F.size(left) > 0) | (F.size(right) > 0)
    label = F.concat(name, F.lit("="))
    listed = shared if shown is None else F.slice(shared, 1, shown)
    return F.struct(
        F.when(
            F.size(shared) > 0, F.concat(label, F.array_join(listed, "|"))
        ).alias("match"),
        F.when(both & (F.size(shared) == 0), F.concat(label, _conflict(left, right))).alias(
            "conflict"
        ),
        F.when(either & ~both, name).alias("missing"),
    )


def with_evidence(
    df: DataFrame,
    left: str = "left_card",
    right: str = "right_card",
    groups: Groups = fixed.IDENTITY_GROUPS,
    shown_values: int | None = None,
    shown_identifiers: int | None = None,
) -> DataFrame:
    """Add the text arrays ``matches``, ``conflicts`` and ``missing`` from two item cards.

    All shared values are listed unless a number to show is given.
    """
    a, b = F.col(left), F.col(right)
    names = F.array(*[F.lit(name) for name in groups])
    sides = F.zip_with(
        a["identity"], b["identity"], lambda x, y: F.struct(x.alias("l"), y.alias("r"))
    )
    per_group = F.zip_with(
        names, sides, lambda n, s: _compare(n, s.l, s.r, shown_values)
    )
    by_title = _compare(F.lit("title_id"), a["title_ids"], b["title_ids"], shown_identifiers)
    compared = df.withColumn("_compared", F.concat(per_group, F.array(by_title)))

    def texts(source: Column, field: str) -> Column:
        found = F.transform(source, lambda e: e[field])
        return F.filter(found, lambda t: t.isNotNull()).alias(field_names[field])

    field_names = {"match": "matches", "conflict": "conflicts", "missing": "missing"}
    every = F.col("_compared")
    # A title without identifiers is not a missing identity field.
    return compared.select(
        *df.columns,
        texts(every, "match"),
        texts(every, "conflict"),
        texts(F.slice(every, 1, len(groups)), "missing"),
    )


def pair_text(category: Column, left: Column, right: Column) -> Column:
    """Canonical text of a pair, the same for (a, b) and (b, a).

    Reads the evidence columns next to the cards; ``category`` is normalised already.
    """
    swap = right["sort_key"] < left["sort_key"]

    def side(field: str, first: bool) -> Column:
        return (
            F.when(swap, right[field] if first else left[field])
            .otherwise(left[field] if first else right[field])
        )

    def listed(field: str, glue: str) -> Column:
        joined = F.array_join(F.col(field), glue)
        return F.when(joined == "", F.lit("none")).otherwise(joined)

    head = F.array(
        F.concat(
            F.lit("[CATEGORY] "),
            F.when(category == "", F.lit(fixed.MISSING_MARK)).otherwise(category),
        ),
        F.concat(F.lit("[LEFT] [TITLE] "), side("title", True)),
        F.concat(F.lit("[RIGHT] [TITLE] "), side("title", False)),
        F.concat(F.lit("[MATCH] "), listed("matches", "; ")),
        F.concat(F.lit("[CONFLICT] "), listed("conflicts", "; ")),
        F.concat(F.lit("[MISSING_IDENTITY] "), listed("missing", ",")),
        F.concat(F.lit("[LEFT] [ATTRIBUTES] "), side("state", True)),
        F.concat(F.lit("[RIGHT] [ATTRIBUTES] "), side("state", False)),
    )
    interleaved = F.flatten(
        F.zip_with(
            side("lines", True),
            side("lines", False),
            lambda l, r: F.array(
                F.concat(F.lit("[LEFT] [ATTR] "), l), F.concat(F.lit("[RIGHT] [ATTR] "), r)
            ),
        )
    )
    body = F.filter(interleaved, lambda line: line.isNotNull())
    return F.array_join(F.concat(head, body), "\n")
