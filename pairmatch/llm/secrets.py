"""Secret scans: three fixed patterns, and character Markov models for what they miss.

Two first-order character models are trained on the corpus itself. The samples are labelled
by form: values that the base patterns find are random strings, runs of ASCII letters are
ordinary identifiers and words. Every long run of key characters, outside the base spans, is
then scored by the mean log-likelihood ratio per character between the two models, and reported
above a threshold: the whole run, or else its best parts, such as a value behind a long name.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairmatch.llm.common import fresh, query, quoted, table, whole

# The base patterns, in the order in which equal starts are listed.
ASSIGN = r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "markov")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

#: Characters of a candidate, one model state each; all others end it.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STATES = len(ALPHABET)
START = STATES


def compiled():
    """The base patterns. Runs too short to report are skipped by the repeat count itself:
    a maximal run either holds it at its first character or nowhere."""
    return (
        re.compile(ASSIGN),
        re.compile(r"AKIA[A-Z0-9]{%d,}" % (LEAST_ACCESS - 4)),
        re.compile(r"[0-9a-f]{%d,}" % LEAST_HEX),
    )


def base_spans(text: str, patterns) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, value) of the base matches, sorted."""
    assign, access, hexes = patterns
    found = []
    for m in assign.finditer(text):
        if len(m[2]) >= LEAST_ASSIGN:
            found.append((m.start(), 0, m.end(), m[2]))
    for kind, pattern in ((1, access), (2, hexes)):
        found += [(m.start(), kind, m.end(), m[0]) for m in pattern.finditer(text)]
    found.sort()
    return found


def _classes():
    import numpy as np

    code = np.full(256, STATES, np.int64)
    for i, c in enumerate(ALPHABET):
        code[ord(c)] = i
    return code


def transition_counts(docs: DataFrame, text: str, least_word: int = 6) -> DataFrame:
    """``label, before, after, n``: character pairs of the labelled strings of all documents.

    Label 1 are the values of the base matches, label 0 the runs of at least ``least_word``
    ASCII letters outside them that no digit or key sign touches. ``before`` is the start state
    at the first character. A task hands on one row per pair of states, however many texts it
    reads.
    """

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        patterns, code = compiled(), _classes()
        letters = re.compile(rb"(?<![A-Za-z0-9+/=])[A-Za-z]{%d,}+(?![0-9+/=])" % least_word)
        total = np.zeros((2, STATES + 1, STATES + 1), np.int64)

        def add(label: int, joined: bytes) -> None:
            # Strings are joined by a byte outside the alphabet, which acts as the start state.
            states = code[np.frombuffer(joined, np.uint8)]
            pair = states[:-1] * (STATES + 1) + states[1:]
            total[label] += np.bincount(pair, minlength=(STATES + 1) ** 2).reshape(total[label].shape)

        for batch in batches:
            for value in batch.column(0):
                whole_text = value.as_py()
                spans = base_spans(whole_text, patterns)
                if spans:
                    add(1, ("\0" + "\0".join(s[3] for s in spans)).encode())
                    pieces, at = [], 0
                    for start, _, end, _ in spans:
                        pieces.append(whole_text[at : max(at, start)])
                        at = max(at, end)
                    whole_text = "\0".join([*pieces, whole_text[at:]])
                words = letters.findall(whole_text.encode())
                if words:
                    add(0, b"\0" + b"\0".join(words))
        label, before, after = np.nonzero(total[:, :, :STATES])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(label, pa.int64()),
                pa.array(before, pa.int64()),
                pa.array(after, pa.int64()),
                pa.array(total[label, before, after], pa.int64()),
            ],
            names=["label", "before", "after", "n"],
        )

    counted = docs.select(whole(quoted(text)).alias("text")).mapInArrow(
        count, "label long, before long, after long, n long"
    )
    return counted.groupBy("label", "before", "after").agg(F.sum("n").alias("n"))


def fit(counts, smoothing: float = 1.0, flat: float = 500.0) -> list[list[float]]:
    """Log-likelihood ratio (random over ordinary) for every pair of states.

    ``counts`` are (label, before, after, n). The random model is smoothed with ``flat``
    pseudo-pairs per state spread evenly, since strings from a uniform generator are what it
    stands for even where few or no examples were found; the ordinary one by ``smoothing``.
    Without any sample both are even and no string scores.
    """
    table_ = [[[0.0] * STATES for _ in range(STATES + 1)] for _ in range(2)]
    for label, before, after, n in counts:
        table_[label][before][after] += n
    ratio = []
    for before in range(STATES + 1):
        random_total = sum(table_[1][before]) + flat
        plain_total = sum(table_[0][before]) + smoothing * STATES
        ratio.append(
            [
                math.log((table_[1][before][a] + flat / STATES) / random_total)
                - math.log((table_[0][before][a] + smoothing) / plain_total)
                for a in range(STATES)
            ]
        )
    return ratio


def _free(start: int, end: int, taken, at: int) -> Iterator[tuple[int, int]]:
    """The parts of a run that no base span from ``taken[at]`` on covers."""
    while at < len(taken) and taken[at][0] < end:
        if taken[at][0] > start:
            yield start, taken[at][0]
        start = max(start, taken[at][2])
        at += 1
    if start < end:
        yield start, end


def best_parts(run: str, scores, least: int) -> list[tuple[int, int]]:
    """Parts of at least ``least`` characters whose ``scores`` (over the threshold) sum to 0 or more.

    One pass holds the best part that ends at each character and its peak, which is cut off
    once it is ``least`` characters behind or the sum fell under 0; so it is linear in the run.
    A part grows to the signs around it while its sum stays, and parts that meet are one.
    """
    sums = [0.0]
    for x in scores:
        sums.append(sums[-1] + x)
    found, first, right = [], 0, 0
    while first + least <= len(run):
        low, peak = first, None
        for end in range(first + least, len(run) + 1):
            if sums[end - least] < sums[low]:
                low = end - least
            got = sums[end] - sums[low]
            if got >= 0 and (peak is None or got >= peak[0]):
                peak = (got, low, end)
            elif peak and (got < 0 or end - peak[2] >= least):
                break
        if peak is None:
            break
        _, start, end = peak
        first = end
        floor = found[-1][1] if found else 0
        left, right = start, max(right, end)
        while left > floor and run[left - 1] not in "+/_=-":
            left -= 1
        while right < len(run) and run[right] not in "+/_=-":
            right += 1
        if right > end and sums[right] >= sums[start]:
            end = right
        if left < start and sums[end] >= sums[left]:
            start = left
        while end - start > least and run[start] in "+/_=-":
            start += 1
        if found and found[-1][1] >= start:
            start = found.pop()[0]
        found.append((start, end))
        first = max(first, end)
    return found


def markov_spans(text: str, candidates, ratio, threshold: float, taken, least: int = 20) -> list[tuple[int, int, int, str]]:
    """Runs outside the base spans whose mean log ratio reaches the threshold, or their parts that do."""
    found, at, reached = [], 0, 0
    for m in candidates.finditer(text):
        # Both go up through the text: the furthest end of the base spans that start before here.
        while at < len(taken) and taken[at][0] <= m.start():
            reached = max(reached, taken[at][2])
            at += 1
        for start, end in _free(max(m.start(), reached), m.end(), taken, at):
            if end - start < least:
                continue
            run, before, scores = text[start:end], START, []
            for c in run:
                after = ALPHABET.index(c)
                scores.append(ratio[before][after] - threshold)
                before = after
            parts = [(0, len(run))] if sum(scores) >= 0 else best_parts(run, scores, least)
            found += [(start + a, 3, start + b, run[a:b]) for a, b in parts]
    return found


def scan(
    docs: DataFrame,
    text: str,
    least_run: int = 20,
    threshold: float = 0.25,
    smoothing: float = 1.0,
) -> DataFrame:
    """Add ``secrets``: an array of (kind, start, end, value) in order of start, then kind.

    Positions are code points, the end exclusive. Kinds are the three base patterns and
    ``markov`` (runs of ``least_run`` or more key characters). Two passes over the whole
    texts: one counts character pairs, at most 2 x 68 x 67 sums for any corpus, one scans.
    Null texts are read as empty and have no secrets, as do empty tables; repeated rows get
    equal results; a column named ``secrets`` raises; all other columns are kept.
    """
    if "secrets" in {c.lower() for c in docs.columns}:
        raise ValueError("the documents already have a column secrets")
    ratio = fit([tuple(r) for r in transition_counts(docs, text).collect()], smoothing)
    kind = T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
            T.StructField("value", T.StringType()),
        ]
    )
    name = fresh(docs.columns, "secrets")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(kind))])
    at = docs.columns.index(text)

    def find(batches: Iterator) -> Iterator:
        import pyarrow as pa

        patterns = compiled()
        candidates = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % least_run)
        arrow = pa.list_(
            pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])
        )
        for batch in batches:
            rows = []
            for value in batch.column(at):
                body = value.as_py() or ""
                spans = base_spans(body, patterns)
                spans = sorted(spans + markov_spans(body, candidates, ratio, threshold, spans, least_run))
                rows.append([{"kind": KINDS[k], "start": s, "end": e, "value": v} for s, k, e, v in spans])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(rows, arrow)], names=[*batch.schema.names, name]
            )

    return docs.mapInArrow(find, schema)


def listed(spans, only_base: bool = False):
    """kind:start:end of an array of spans, comma-joined."""
    kept = F.filter(spans, lambda s: s["kind"] != "markov") if only_base else spans
    return F.array_join(
        F.transform(
            kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        ),
        ",",
    )


def of_kind(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


@query()
def op2_markov_secrets(spark, sf_dir):
    """Secrets in every whole text: counts per base kind, digest of the base spans, all spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, "text").select(
        "doc_id",
        *[
            of_kind(F.col("secrets"), k).alias(f"n_{k}")
            for k in KINDS[:3]
        ],
        F.sha2(listed(F.col("secrets"), only_base=True), 256).alias("base_sha256"),
        listed(F.col("secrets")).alias("spans"),
    )
