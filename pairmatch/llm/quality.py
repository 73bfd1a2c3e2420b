"""Quality rules by host: a document's own rules, and its host's shrunk rate of failures.

Rules look at one text each. Their failures are summed up by host, the hosts' rates are
shrunk towards the corpus by a beta prior fitted to all hosts (few documents say little about
a host), and hosts above a rate are distrusted. A document goes if it fails a base rule, or
if its host is distrusted and it fails any rule itself: clean documents stay everywhere.
Only built-in expressions are used; nothing leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmatch.llm.common import fresh, publish, query, quoted, table, whole
from pairmatch.session import settle

# White space between words, and the characters that count as symbols.
GAP = r"[\x20\x09-\x0D]+"
NO_SYMBOL = r"[^#*$%&|<>]+"
LEAST_WORDS = 50
MOST_REPEATED = 50
#: The method's further rules, as shares of the text: symbols per word, repeated lines.
MOST_SYMBOLS = 0.3
MOST_DUP_LINES = 0.3
#: Hosts at or above this shrunk rate are distrusted.
MOST_FAILING = 0.5

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def measure(docs: DataFrame, text: str) -> DataFrame:
    """Add the metrics of every whole text.

    ``n_repeat_words`` counts the words that lie in a three-word window which occurs at
    least twice. Windows are compared by 64-bit hashes in a sorted array, so a text of n
    words costs n log n: the sorted hashes tell whether any repeats, and only then the pairs
    (hash, place) are sorted too, the places of repeated windows put in order, and the gaps
    between them, three words at most each, added up. Null and empty texts have 0 of all.
    """
    names = {n: fresh(docs.columns, "_" + n) for n in ("words", "lines", "windows", "sorted", "pairs", "places")}
    words, lines, windows, ordered, pairs, places = (F.col(n) for n in names.values())
    body = whole(quoted(text))
    size = F.size(words)
    df = docs.withColumns(
        {
            names["words"]: F.filter(F.split(body, GAP), lambda w: w != ""),
            names["lines"]: F.filter(
                F.split(body, "\n"), lambda line: F.length(F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))) > 0
            ),
        }
    )
    df = df.withColumns(
        {
            "n_words": size.cast("long"),
            "word_chars": F.length(F.array_join(words, "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(body, NO_SYMBOL, "")).cast("long"),
            "n_lines": F.size(lines).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            names["windows"]: F.when(
                size >= 3,
                F.transform(
                    F.sequence(F.lit(1), size - 2),
                    lambda i: F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)),
                ),
            ).otherwise(F.array().cast("array<bigint>")),
        }
    )
    df = df.withColumn(
        names["pairs"],
        # Distinct hashes are counted on primitive longs; most texts end here.
        F.when(
            F.size(F.array_distinct(windows)) < F.size(windows),
            F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    df = df.withColumn(
        names["places"],
        F.array_sort(
            F.transform(
                F.filter(
                    pairs,
                    lambda p, i: F.get(pairs, i - 1)["h"].eqNullSafe(p["h"])
                    | F.get(pairs, i + 1)["h"].eqNullSafe(p["h"]),
                ),
                lambda p: p["i"],
            )
        ),
    )
    covered = F.aggregate(
        F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1), p + 3) - p)),
        F.lit(0),
        lambda total, n: total + n,
    )
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    # The generator keeps later filters on the metrics above it: pushed below, they would put
    # the splitting of the text inside the functions that run once per word.
    return df.select(*map(quoted, docs.columns), F.inline(F.array(F.struct(*METRICS))))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    )


def any_failed() -> Column:
    return (
        base_failed()
        | (F.col("n_symbols") > MOST_SYMBOLS * F.col("n_words"))
        | (F.col("n_dup_lines") > MOST_DUP_LINES * F.col("n_lines"))
    )


def host_rates(measured: DataFrame, host: str) -> DataFrame:
    """``host, documents, failures, rate``: failures of any rule, shrunk by the beta prior.

    The prior's mean is the share of failing documents in the corpus, its strength comes
    from the spread of the hosts' rates around it, weighted by their documents (method of
    moments): no spread beyond chance gives a strong prior, and every host the mean. Hosts
    are summed map-side, the prior is one row. A null host is a host of its own.
    """
    # Read for the prior and for the rates: summed up once.
    hosts = settle(
        measured.groupBy(quoted(host).alias("host")).agg(
            F.count(F.lit(1)).alias("documents"), F.count_if(any_failed()).alias("failures")
        )
    )
    n, k = F.col("documents"), F.col("failures")
    sums = hosts.agg(
        F.sum(n).alias("n"),
        F.sum(k).alias("k"),
        F.sum(n * n).alias("nn"),
        F.sum(k * k / n).alias("kk"),
        F.count(F.lit(1)).alias("hosts"),
    )
    mean = F.col("k") / F.col("n")
    # Weighted spread of the rates, less what chance alone gives, over what is left of the weights.
    spread = (F.col("kk") - F.col("k") * mean) - (F.col("hosts") - 1) * mean * (1 - mean)
    room = F.col("n") - F.col("nn") / F.col("n") - (F.col("hosts") - 1)
    share = F.when(room > 0, spread / (room * mean * (1 - mean)))
    strength = F.when(share > 0, F.least(F.greatest(1 / share - 1, F.lit(1.0)), F.lit(1e6))).otherwise(1e6)
    # One row of two numbers; an empty table has no hosts to judge.
    prior = sums.select(
        F.coalesce(mean, F.lit(0.0)).alias("mean"),
        F.when((mean > 0) & (mean < 1), strength).otherwise(1e6).alias("strength"),
    ).first()
    return hosts.select(
        "host",
        "documents",
        "failures",
        ((k + prior["strength"] * prior["mean"]) / (n + prior["strength"])).alias("rate"),
    )


def judge(docs: DataFrame, text: str, host: str, carried: Sequence[str] | None = None) -> DataFrame:
    """Add the metrics, ``base_failed``, ``host_rate`` and ``kept`` to every document.

    ``carried`` are the columns that go along (default all). Without the text among them the
    measured rows are published once for both uses; with it they are measured a second time,
    as writing the texts again would cost more disk. Hosts' rates are joined back on the
    host, where the big side of a hot host is split by the adaptive skew join and a small
    table of hosts is broadcast by the planner. Null texts fail as empty ones, null hosts are
    one host, repeated rows each count, empty tables stay empty; a clash with a new name raises.
    """
    carried = list(carried if carried is not None else docs.columns)
    added = [*METRICS, "base_failed", "host_rate", "kept"]
    if clash := set(added) & {c.lower() for c in carried}:
        raise ValueError(f"the documents already have {sorted(clash)}")
    measured = measure(docs, text).select(*map(quoted, carried), *METRICS)
    if text not in carried:
        measured = publish(measured)
    return with_hosts(measured, host_rates(measured, host), host)


def with_hosts(measured: DataFrame, rates: DataFrame, host: str) -> DataFrame:
    mark = fresh(measured.columns, "_host")
    rates = rates.select(F.col("host").alias(mark), F.col("rate").alias("host_rate"))
    return (
        measured.join(rates, quoted(host).eqNullSafe(F.col(mark)), "left")
        .drop(mark)
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~(base_failed() | ((F.col("host_rate") >= MOST_FAILING) & any_failed())))
    )


OP5_SQL = rf"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text FROM documents),
words AS (SELECT row, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM d),
grams AS (SELECT row, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM words, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i)),
twice AS (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS n FROM grams),
covered AS (SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest([i, i + 1, i + 2]) AS p FROM twice WHERE n > 1)
  GROUP BY row),
parts AS (SELECT row, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
m AS (SELECT d.row, doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
  CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN words USING (row) JOIN parts USING (row) LEFT JOIN covered USING (row)),
f AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM m),
g AS (SELECT *, base_failed OR n_symbols > {MOST_SYMBOLS} * n_words OR n_dup_lines > {MOST_DUP_LINES} * n_lines AS failed FROM f),
hosts AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (failed) AS DOUBLE) AS k FROM g GROUP BY source),
sums AS (SELECT sum(n) AS n, sum(k) AS k, sum(n * n) AS nn, sum(k * k / n) AS kk, count(*) AS hosts, sum(k) / sum(n) AS mean FROM hosts),
share AS (SELECT *, CASE WHEN mean > 0 AND mean < 1 AND n - nn / n - (hosts - 1) > 0 THEN
  ((kk - k * mean) - (hosts - 1) * mean * (1 - mean)) / ((n - nn / n - (hosts - 1)) * mean * (1 - mean)) END AS s FROM sums),
prior AS (SELECT mean, CASE WHEN s > 0 THEN least(greatest(1 / s - 1, 1), 1000000) ELSE 1000000 END AS strength FROM share),
rates AS (SELECT source, (k + strength * mean) / (hosts.n + strength) AS rate FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR (rate >= {MOST_FAILING} AND failed)) AS kept
FROM g JOIN rates ON g.source IS NOT DISTINCT FROM rates.source"""


@query(sql=OP5_SQL)
def op5_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base metrics and the verdict for every document; ``source`` is the host."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return judge(docs, "text", "source", carried=["doc_id", "source"]).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )
