"""Personal data: overlapping candidates, boosted trees over their form and context, thresholds.

High-recall patterns propose spans of whole texts. What a base pattern finds and its check
confirms (octets, Luhn digits, number of digits) is always redacted. All candidates of the
corpus, confirmed or not, are counted by their form and context; boosted trees learn from
these counts which forms are confirmed, without seeing the checks, and a threshold per kind,
calibrated on counts kept aside, selects further candidates: a card number with a slip in one
digit looks like the confirmed ones around it. The method's own kinds, which no base check
confirms, have evidence of their own: a written-out address that reads as an address with its
signs put back, and a number of a phone's length after a word for one. Texts are worked on with built-in expressions
only; the trees are fitted to one small table of counts and applied as expressions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmatch.llm.common import fresh, publish, query, quoted, table, whole

# The base patterns of the contract in forms that can't run long. Possessive
# repeats give nothing back, which changes no match here, as what follows can't start with what
# they took. A match starts where its run of characters starts or where the last match ended
# (inside a run that failed from its start, every later start fails too). A chain of fewer than
# 12 digits is no card, so the repeat count skips it. Repeated groups are possessive throughout:
# others recurse once per repeat, and a long value would exhaust a task's stack.
LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: The method's own generators: written-out addresses, and numbers of 9 to 19 digits in any grouping.
SPELT = rf"(?:(?<!{LOCAL})|\G){LOCAL}++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++(?:\x20?(?:[(\[]dot[)\]]|\.)\x20?[A-Za-z0-9-]++)++"
NUMBER = r"[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){8,18}+"
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "spelt": SPELT, "number": NUMBER}
BASE = ("email", "ip", "card", "phone")
OCTETS = r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})(?:\.|$)){4}$"
HINTS = r"(?i)(?:tel|phone|call|fax|mobil|mail|contact|card|visa|account|ssn|address|\bip\b|host)[^0-9A-Za-z]*$"
CALLS = r"(?i)(?:tel|telephone|phone|call|fax|mobile?|cell)[^0-9A-Za-z]*$"
#: A written-out address whose dots are written out too or stand without spaces, under a domain of letters.
WRITTEN = rf"^{LOCAL}++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++(?:(?:\x20?[(\[]dot[)\]]\x20?|\.)[A-Za-z0-9-]++)*+(?<=[)\]\x20.][A-Za-z]{{2,24}})$"
CONTEXT = 16

#: Features of a candidate and their number of values.
FEATURES = {"kind": len(PATTERNS), "digits": 7, "breaks": 6, "left": 5, "right": 5, "hint": 2, "lead": 4, "other": 4, "dots": 4}


def _running(values: Column, first: Column, step, block: int = 256) -> Column:
    """The states of a fold over an array, one behind every element.

    The fold runs inside blocks and hands its last state on, so an array under construction
    is never copied more often than the square root of its length asks for.
    """
    def inside(parts: Column, part: Column) -> Column:
        ran = F.aggregate(
            part,
            F.array(F.element_at(F.element_at(parts, -1), -1)),
            lambda got, x: F.concat(got, F.array(step(F.element_at(got, -1), x))),
        )
        return F.concat(parts, F.array(F.slice(ran, F.lit(2), F.size(part))))

    def ran(values: Column) -> Column:
        count = F.ceil(F.size(values) / block).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.slice(values, b * block + 1, F.lit(block)))
        made = F.aggregate(blocks, F.array(F.array(first)), inside)
        return F.when(count > 0, F.flatten(F.slice(made, F.lit(2), count))).otherwise(
            F.filter(F.array(first), lambda x: F.lit(False))
        )

    # Bound to a name by a transform of one element: an expression would be worked out per block.
    return F.get(F.transform(F.array(values), ran), F.lit(0))


def _start_points(values: Column, gaps: Column) -> Column:
    """Where each match starts: the lengths of all gaps and matches before it."""
    sizes = F.transform(values, lambda v: F.length(v).cast("long"))
    between = F.transform(F.slice(gaps, F.lit(1), F.size(values)), lambda g: F.length(g).cast("long"))
    ends = _running(F.zip_with(between, sizes, lambda g, v: g + v), F.lit(0).cast("long"), lambda at, x: at + x)
    return F.zip_with(ends, sizes, lambda end, v: end - v)


def _bucket(number: Column, edges: Sequence[int]) -> Column:
    out = F.lit(len(edges))
    for i, edge in reversed(list(enumerate(edges))):
        out = F.when(number <= edge, i).otherwise(out)
    return out


def _side(char: Column) -> Column:
    return (
        F.when(char == "", 0)
        .when(char.rlike(r"\s"), 1)
        .when(char.rlike(r"[\p{L}\p{N}_]"), 2)
        .when(char.rlike(r"[.,;:!?]"), 3)
        .otherwise(4)
    )


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def confirmed(kind: str, value: Column) -> Column:
    """The base check of a kind; the method's own kinds have none."""
    count = F.length(_digits(value))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(OCTETS)
    if kind == "card":
        return count.between(12, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return count.between(9, 15)
    return F.lit(False)


def evident(kind: str, value: Column, before: Column) -> Column:
    """Evidence for the method's own kinds, from the whole value or the words before it."""
    if kind == "spelt":
        return value.rlike(WRITTEN)
    if kind == "number":
        return F.length(_digits(value)).between(9, 15) & before.rlike(CALLS)
    return F.lit(False)


def candidates(docs: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: every candidate as (start, rank, end, kind, sure, value, seen, features).

    Positions are code points, the end exclusive. A pattern's matches and the gaps between
    them come from the same pattern, so their lengths add up to the positions; all work is
    linear in the text. Texts without a digit or a sign that a pattern needs skip it.
    """
    body = whole(quoted(text))
    gates = {
        "email": F.instr(body, "@") > 0,
        "ip": body.rlike(r"[0-9]\.[0-9]"),
        "card": body.rlike(r"[0-9][\x20-]?[0-9]"),
        "phone": body.rlike(r"\+[0-9]"),
        "spelt": body.rlike(r"[(\[]at[)\]]"),
        "number": body.rlike(r"[0-9][\x20().-]{0,2}[0-9]"),
    }
    col = {(p, k): fresh(docs.columns, f"_{p}_{k}") for p in "vgs" for k in PATTERNS}
    nothing = F.array().cast("array<string>")
    df = docs.withColumns(
        {
            col["v", k]: F.when(gates[k], F.regexp_extract_all(body, F.lit(p), F.lit(0))).otherwise(nothing)
            for k, p in PATTERNS.items()
        }
    )
    df = df.withColumns(
        {
            col["g", k]: F.when(F.size(col["v", k]) > 0, F.split(body, p, -1)).otherwise(nothing)
            for k, p in PATTERNS.items()
        }
    )
    for k in PATTERNS:
        values, gaps = F.col(col["v", k]), F.col(col["g", k])
        df = df.withColumn(col["s", k], _start_points(values, gaps))
    parts = [
        _described(rank, k, F.col(col["v", k]), F.col(col["g", k]), F.col(col["s", k]))
        for rank, k in enumerate(PATTERNS)
    ]
    return df.withColumn(out, F.array_sort(F.concat(*parts))).select(*map(quoted, docs.columns), out)


def _described(rank: int, kind: str, values: Column, gaps: Column, starts: Column) -> Column:
    def one(match: Column) -> Column:
        value, start = match["value"], match["start"]
        before = F.right(match["before"], F.lit(CONTEXT))
        after = F.left(match["after"], F.lit(1))
        digits = F.length(_digits(value))
        breaks = F.length(F.regexp_replace(value, r"[^\x20().-]", ""))
        first = F.left(value, F.lit(1))
        return F.struct(
            start.alias("start"),
            F.lit(rank).alias("rank"),
            (start + F.length(value)).alias("end"),
            F.lit(kind).alias("name"),
            confirmed(kind, value).alias("sure"),
            value.alias("value"),
            evident(kind, value, before).alias("seen"),
            F.struct(
                F.lit(rank).alias("kind"),
                _bucket(digits, (0, 5, 8, 11, 15, 19)).alias("digits"),
                F.least(breaks, F.lit(5)).alias("breaks"),
                _side(F.right(before, F.lit(1))).alias("left"),
                _side(after).alias("right"),
                before.rlike(HINTS).cast("int").alias("hint"),
                F.when(first == "+", 0)
                .when(first == "(", 1)
                .when(first.rlike("[0-9]"), 2)
                .otherwise(3)
                .alias("lead"),
                _bucket(F.length(value) - digits - breaks, (0, 4, 16)).alias("other"),
                F.when(value.rlike(r"\.\x20|\x20\."), 3)
                .when(value.rlike(r"[(\[]dot[)\]]"), 2)
                .when(F.instr(value, ".") > 0, 1)
                .otherwise(0)
                .alias("dots"),
            ).alias("f"),
        )

    count = F.size(values)
    # Zipped, not looked up inside the transform: an array read there may be worked out per match.
    matches = F.arrays_zip(
        values.alias("value"),
        starts.alias("start"),
        F.slice(gaps, F.lit(1), count).alias("before"),
        F.slice(gaps, F.lit(2), count).alias("after"),
    )
    return F.transform(matches, one)


def _crossed(spans: Column) -> Column:
    """For every candidate, in order of starts, whether it lies over a confirmed one (not itself).

    A confirmed span that comes earlier overlaps if it ends behind the candidate's start, one
    that comes later if it starts before the candidate's end; so the largest end so far and
    the smallest start from the other side tell, in one pass each way.
    """
    never = F.lit((1 << 62)).cast("long")
    ends = F.transform(spans, lambda s: F.when(s["sure"], s["end"]).otherwise(F.lit(-1).cast("long")))
    starts = F.transform(spans, lambda s: F.when(s["sure"], s["start"]).otherwise(never))
    reach = _running(ends, F.lit(-1).cast("long"), lambda most, x: F.greatest(most, x))
    ahead = F.reverse(_running(F.reverse(starts), never, lambda least, x: F.least(least, x)))
    count = F.size(spans)
    rows = F.arrays_zip(
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("s"),
        F.slice(F.concat(F.array(F.lit(-1).cast("long")), reach), F.lit(1), count).alias("reach"),
        F.slice(F.concat(ahead, F.array(never)), F.lit(2), count).alias("ahead"),
    )
    met = F.transform(rows, lambda r: (r["reach"] > r["s"]["start"]) | (r["ahead"] < r["s"]["end"]))
    return F.when(count > 0, met).otherwise(F.array().cast("array<boolean>"))


def counts(found: DataFrame, spans: str) -> list[tuple[tuple[int, ...], int, int, int]]:
    """(features, label, fold, n) over all candidates of the corpus.

    A candidate counts as confirmed if it is, if it lies over a confirmed one, or if there is
    evidence for its kind (``evident``). A quarter
    of the candidates, by a hash of the value, is the fold kept aside. The rows are bounded
    by the feature values (``FEATURES``) and summed before they are shuffled.
    """
    one = F.explode(
        F.zip_with(
            F.col(spans),
            _crossed(F.col(spans)),
            lambda s, crossed: F.struct(
                s["f"].alias("f"),
                (s["sure"] | s["seen"] | crossed).cast("int").alias("label"),
                (F.pmod(F.xxhash64(s["value"]), F.lit(4)) == 0).cast("int").alias("fold"),
            ),
        )
    )
    rows = found.select(one.alias("c")).groupBy("c.f", "c.label", "c.fold").agg(F.count(F.lit(1)).alias("n"))
    return [(tuple(r["f"]), r["label"], r["fold"], r["n"]) for r in rows.collect()]


class Trees:
    """Gradient boosting with the logistic loss over counted cells; trees of depth two."""

    def __init__(self, rounds: int = 24, rate: float = 0.3, ridge: float = 1.0):
        self.rounds, self.rate, self.ridge = rounds, rate, ridge
        self.names = list(FEATURES)
        self.base = 0.0
        #: (feature, cut, (feature, cut, low, high) below, the same above); low means <= cut
        self.trees: list = []

    def _leaf(self, rows) -> float:
        gradient = sum(r[1] for r in rows)
        return self.rate * gradient / (sum(r[2] for r in rows) + self.ridge)

    def _cut(self, rows):
        """The cut of (features, gradient, curvature) rows that gains most."""
        best = (1e-9, None, None)
        total_g, total_h = sum(r[1] for r in rows), sum(r[2] for r in rows)
        parent = total_g**2 / (total_h + self.ridge)
        for j, size in enumerate(FEATURES.values()):
            g, h = [0.0] * size, [0.0] * size
            for f, a, b in rows:
                g[f[j]] += a
                h[f[j]] += b
            left_g = left_h = 0.0
            for cut in range(size - 1):
                left_g, left_h = left_g + g[cut], left_h + h[cut]
                gain = (
                    left_g**2 / (left_h + self.ridge)
                    + (total_g - left_g) ** 2 / (total_h - left_h + self.ridge)
                    - parent
                )
                if gain > best[0]:
                    best = (gain, j, cut)
        return best[1], best[2]

    def fit(self, cells) -> "Trees":
        """``cells`` are (features, label, n); rows of equal features are added up."""
        tally: dict = {}
        for f, label, n in sorted(cells):
            tally.setdefault(f, [0, 0])[label] += n
        ones, noughts = (sum(t[i] for t in tally.values()) for i in (1, 0))
        self.base = math.log((ones + 1) / (noughts + 1))
        margin = dict.fromkeys(tally, self.base)
        for _ in range(self.rounds):
            rows = []
            for f, (zero, one) in tally.items():
                p = 1 / (1 + math.exp(-max(-30.0, min(30.0, margin[f]))))
                rows.append((f, one - (zero + one) * p, (zero + one) * p * (1 - p)))
            feature, cut = self._cut(rows)
            if feature is None:
                break
            sides = []
            for low in (True, False):
                part = [r for r in rows if (r[0][feature] <= cut) == low]
                inner, at = self._cut(part)
                if inner is None:
                    value = self._leaf(part)
                    sides.append((0, -1, value, value))
                else:
                    split = [[r for r in part if (r[0][inner] <= at) == side] for side in (True, False)]
                    sides.append((inner, at, self._leaf(split[0]), self._leaf(split[1])))
            self.trees.append((feature, cut, *sides))
            for f in margin:
                margin[f] += self._value(self.trees[-1], f)
        return self

    @staticmethod
    def _value(tree, f) -> float:
        feature, cut, below, above = tree
        inner, at, low, high = below if f[feature] <= cut else above
        return low if f[inner] <= at else high

    def score(self, f) -> float:
        margin = self.base + sum(self._value(t, f) for t in self.trees)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, margin))))

    def column(self, f: Column) -> Column:
        """The same score as an expression over the feature struct."""

        def side(branch) -> Column:
            inner, at, low, high = branch
            if low == high:
                return F.lit(low)
            return F.when(f[self.names[inner]] <= at, low).otherwise(F.lit(high))

        margin = F.lit(self.base)
        for feature, cut, below, above in self.trees:
            margin = margin + F.when(f[self.names[feature]] <= cut, side(below)).otherwise(side(above))
        return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), margin))))


def calibrated(model: Trees, cells, precision: float, least: int = 20) -> dict[int, float]:
    """Per kind the lowest score whose candidates, from it upwards, are confirmed at the wanted
    rate among the counts kept aside; 2 (never reached) where none is or too few were seen."""
    out = {}
    for kind in range(len(PATTERNS)):
        own = sorted(((model.score(f), label, n) for f, label, n in cells if f[0] == kind), reverse=True)
        right = total = 0
        out[kind] = 2.0
        for i, (score, label, n) in enumerate(own):
            right, total = right + label * n, total + n
            last = i + 1 == len(own) or own[i + 1][0] < score
            if last and total >= least and right >= precision * total:
                out[kind] = score
    return out


def select(found: DataFrame, spans: str, model: Trees, thresholds: dict[int, float], out: str) -> DataFrame:
    """Replace the candidates by ``out``: confirmed spans, and those over the threshold that lie
    over no confirmed span and no selected earlier one; (start, rank, end, name, value) in order."""
    every = F.col(spans)
    picked = fresh(found.columns, "_picked")

    def limit_of(rank: Column) -> Column:
        return F.get(F.array(*[F.lit(float(thresholds[k])) for k in range(len(PATTERNS))]), rank)

    def slim(s: Column) -> Column:
        # What no check confirmed is named apart, whichever pattern proposed it.
        name = F.when(s["sure"], s["name"]).otherwise(F.concat(F.lit("likely_"), s["name"]))
        kept = [s[n].alias(n) for n in ("start", "rank", "end")]
        return F.struct(*kept, name.alias("name"), s["value"].alias("value"))

    scored = F.transform(
        F.arrays_zip(every.alias("s"), _crossed(every).alias("crossed")),
        lambda z: F.struct(
            z["s"].alias("s"),
            (
                ~z["s"]["sure"] & ~z["crossed"] & (model.column(z["s"]["f"]) >= limit_of(z["s"]["rank"]))
            ).alias("more"),
        ),
    )
    offered = F.filter(scored, lambda z: z["s"]["sure"] | z["more"])
    df = found.withColumn(picked, offered)
    # In order of starts, a further span is taken if the last one taken ended before it.
    start = F.struct(F.lit(-1).cast("long").alias("end"), F.lit(False).alias("taken"))
    states = _running(
        F.col(picked),
        start,
        lambda state, z: F.when(
            z["more"] & (z["s"]["start"] >= state["end"]),
            F.struct(z["s"]["end"].alias("end"), F.lit(True).alias("taken")),
        ).otherwise(F.struct(state["end"].alias("end"), F.lit(False).alias("taken"))),
    )
    both = F.arrays_zip(F.col(picked).alias("z"), states.alias("state"))
    kept = F.filter(both, lambda r: r["z"]["s"]["sure"] | r["state"]["taken"])
    return df.withColumn(out, F.array_sort(F.transform(kept, lambda r: slim(r["z"]["s"])))).drop(picked, spans)


def learn(found: DataFrame, spans: str, precision: float = 0.9) -> tuple[Trees, dict[int, float]]:
    cells = counts(found, spans)
    model = Trees().fit([(f, label, n) for f, label, fold, n in cells if not fold])
    return model, calibrated(model, [(f, label, n) for f, label, fold, n in cells if fold], precision)


def detect(docs: DataFrame, text: str, out: str = "pii", carried: Sequence[str] | None = None) -> DataFrame:
    """Every document with the spans to redact, ``out``.

    ``carried`` are the columns that go along (default all). With few of them the candidates
    are published once and read for both learning and selecting; with the text among them
    they are found a second time instead, which is cheaper than to write the texts again.
    Null texts are read as empty and, as empty tables, have no spans; repeated rows get
    equal spans; a clash with ``out`` raises; a corpus without candidates learns no tree.
    """
    carried = list(carried if carried is not None else docs.columns)
    if out.lower() in {c.lower() for c in carried}:
        raise ValueError(f"the documents already have a column {out}")
    raw = fresh(docs.columns, "_candidates")
    found = candidates(docs, text, raw).select(*map(quoted, carried), raw)
    if text not in carried:
        found = publish(found)
    model, thresholds = learn(found.select(raw), raw)
    return select(found, raw, model, thresholds, out)


def redact(docs: DataFrame, text: str, spans: str) -> DataFrame:
    """Put ``[KIND]`` in place of every span; spans that overlap become one, named by the first."""
    body, every = whole(quoted(text)), F.col(spans)
    merged, parts = fresh(docs.columns, "_merged"), fresh(docs.columns, "_parts")
    zero = F.lit(0).cast("long")
    reach = _running(F.transform(every, lambda s: s["end"]), zero, lambda most, x: F.greatest(most, x))
    rows = F.arrays_zip(
        F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["name"].alias("name"))).alias("s"),
        reach.alias("reach"),
        F.slice(F.concat(F.array(zero), reach), F.lit(1), F.size(every)).alias("before"),
        F.concat(
            F.slice(F.transform(every, lambda s: s["start"]), F.lit(2), F.size(every)),
            F.array(F.lit(1 << 62).cast("long")),
        ).alias("next"),
    )
    # A merged span starts where nothing before reaches, and ends where nothing that follows begins before.
    heads = F.filter(rows, lambda r: r["before"] <= r["s"]["start"])
    tails = F.filter(rows, lambda r: r["reach"] <= r["next"])
    joined = F.zip_with(
        heads,
        tails,
        lambda h, t: F.struct(h["s"]["start"].alias("start"), t["reach"].alias("end"), h["s"]["name"].alias("name")),
    )
    # Parts of a fixed length make every cut as cheap as its own size: a cut from a long text
    # counts its characters from the start.
    cut = 4096
    df = docs.withColumns(
        {
            merged: F.when(F.size(every) > 0, joined),
            parts: F.when(F.size(every) > 0, F.regexp_extract_all(body, F.lit(f"(?s).{{1,{cut}}}"), F.lit(0))),
        }
    )
    spots, held = F.col(merged), F.col(parts)

    def between(first: Column, last: Column) -> Column:
        """Characters ``first`` up to ``last`` of the text."""
        own = F.floor(first / cut).cast("int")
        near = F.slice(held, own + 1, F.floor(last / cut).cast("int") - own + 1)
        return F.substring(F.array_join(near, ""), (first - own * cut + 1).cast("int"), (last - first).cast("int"))

    ends = F.transform(spots, lambda s: s["end"])
    pieces = F.transform(
        F.arrays_zip(spots.alias("s"), F.slice(F.concat(F.array(zero), ends), F.lit(1), F.size(spots)).alias("from")),
        lambda z: F.concat(between(z["from"], z["s"]["start"]), F.lit("["), F.upper(z["s"]["name"]), F.lit("]")),
    )
    tail = between(F.element_at(ends, -1), F.length(body).cast("long"))
    clean = F.when(spots.isNotNull(), F.concat(F.array_join(pieces, ""), tail)).otherwise(quoted(text))
    names = [c for c in docs.columns if c not in (spans,)]
    return df.withColumn(text, clean).select(*map(quoted, names))


def listed(spans: Column) -> Column:
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))
        ),
        ",",
    )


def of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["name"] == kind)).cast("long")


@query()
def op3_boosted_pii(spark, sf_dir):
    """Personal data in every whole text: counts per base kind, digest of the base spans, all spans.

    Base spans are the confirmed ones; a selected card or phone that its check did not confirm
    is listed as ``likely_<kind>``.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = detect(docs, "text", "pii", carried=["doc_id"])
    return summary(found, "doc_id")


def summary(found: DataFrame, key: str) -> DataFrame:
    spans = F.col("pii")
    base = F.filter(spans, lambda s: s["name"].isin(*BASE))
    return found.select(
        quoted(key),
        *[of_kind(spans, k).alias(f"n_{k}") for k in BASE],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(spans).alias("spans"),
    )
