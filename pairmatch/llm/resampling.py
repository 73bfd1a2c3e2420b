"""Importance resampling towards a target distribution over hashed word n-grams.

A batch's texts are joined with a separator sentinel, one regular expression pass finds all
words of all of them, and a binary search over the texts' offsets tells which text each word
belongs to; n-grams whose words lie in two texts are masked before the buckets are counted.

1. Both tables are counted into buckets: a task adds up its own rows and hands on one number
   per bucket, so two short arrays reach the driver whatever the size of the tables.
2. Every document sums the gains of its features, log ratios of the smoothed frequencies.
3. The gains plus Gumbel noise drawn from a hash of the key are ranked; the first ones are
   a sample without replacement in proportion to the importance weights.

The checksum of an n-gram is combined from the checksums of its words: a checksum is linear,
so appending a word is one table look-up per byte of the checksum and not one per letter.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairmatch.llm.common import publish, query, quoted, table
from pairmatch.llm.sharding import _CRC_SQL, crc_sql
from pairmatch.llm.words import chunks
from pairmatch.operators.ranking import ordinal

#: Words are runs of ASCII letters and digits and of all bytes over 127; A-Z are lower-cased before.
WORD = rb"[0-9a-z\x80-\xff]+"
#: Joins the texts of a batch; it is no part of any word.
SENTINEL = b"\0"
#: Longest word whose checksum is shifted by one look-up; longer ones go bit by bit of their length.
SHORT = 48


@dataclass(frozen=True)
class Scheme:
    """Parameters: n-grams of 1 to ``longest`` words in ``buckets``, and what is drawn."""

    longest: int = 3
    buckets: int = 10_000
    #: Texts with fewer words are never drawn.
    least_words: int = 20
    #: Percentage of the texts with enough words that is drawn.
    percent: int = 5
    #: Prefix of the hashed key.
    seed: str = "42"


class Checksums:
    """CRC-32 of many words and n-grams at once."""

    def __init__(self):
        import numpy as np

        c = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
        self.byte = c
        # shift[n, k, b]: what byte k of a checksum, with value b, becomes n zero bytes later.
        step = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
        tables = [step]
        for _ in range(SHORT):
            step = self.byte[step & 255] ^ (step >> 8)
            tables.append(step)
        self.shift = np.stack(tables)
        self.double = [self.shift[1]]
        for _ in range(40):
            self.double.append(self._apply(self.double[-1], self.double[-1]))

    @staticmethod
    def _apply(tables, c):
        return tables[0][c & 255] ^ tables[1][(c >> 8) & 255] ^ tables[2][(c >> 16) & 255] ^ tables[3][c >> 24]

    def words(self, buffer, starts, lengths):
        """The checksum of every word ``buffer[start : start + length]``."""
        import numpy as np

        order = np.argsort(-np.minimum(lengths, SHORT + 1), kind="stable")
        at, size = starts[order], lengths[order]
        long = int(np.searchsorted(-size, -SHORT, "left"))
        out = np.full(len(order), 0xFFFFFFFF, np.uint32)
        left = np.searchsorted(-size, -np.arange(SHORT + 1), "left")
        for j in range(SHORT):
            # Longer words come first: those with a byte at place j are a run.
            last = int(left[j])
            if last <= long:
                break
            c = out[long:last]
            out[long:last] = self.byte[(c ^ buffer[at[long:last] + j]) & 255] ^ (c >> 8)
        out ^= np.uint32(0xFFFFFFFF)
        for i in range(long):
            out[i] = zlib.crc32(buffer[at[i] : at[i] + size[i]])
        back = np.empty_like(out)
        back[order] = out
        return back

    def spaced(self, c):
        """The checksum after one more space."""
        c = ~c
        return ~(self.byte[(c ^ 32) & 255] ^ (c >> 8))

    def joined(self, first, second, length):
        """The checksum of two texts one after the other, the second of that many bytes."""
        import numpy as np

        near = np.minimum(length, SHORT)
        c = self.shift[near, 0, first & 255] ^ self.shift[near, 1, (first >> 8) & 255]
        c ^= self.shift[near, 2, (first >> 16) & 255] ^ self.shift[near, 3, first >> 24]
        rest, bit = length - near, 0
        while rest.any():
            odd = (rest & 1).astype(bool)
            c[odd] = self._apply(self.double[bit], c[odd])
            rest, bit = rest >> 1, bit + 1
        return c ^ second


def pieces(size: int, buffer: bytes, limit: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """(first, last) of parts of about ``limit`` bytes that end between words."""
    gap = re.compile(rb"[^0-9a-z\x80-\xff]")
    at = 0
    while at < size:
        found = gap.search(buffer, min(size, at + limit))
        end = found.end() if found else size
        yield at, end
        at = end


def features(texts: Sequence[str], scheme: Scheme, sums: Checksums) -> Iterator[tuple]:
    """(text numbers, buckets) of all features, n by n, in parts; n = 1 has one row per word.

    The texts are joined once; a part's words carry on from the last words of the part
    before, so a text longer than a part loses no n-gram across its borders.
    """
    import numpy as np

    raw = [t.encode().lower() for t in texts]
    borders = np.cumsum([0, *(len(r) + 1 for r in raw)])
    joined = SENTINEL.join([*raw, b""])
    buffer = np.frombuffer(joined, np.uint8)
    word = re.compile(WORD)
    tail = None
    for first, last in pieces(len(joined), joined):
        spans = np.array([m.span() for m in word.finditer(joined, first, last)], np.int64).reshape(-1, 2)
        starts, lengths = spans[:, 0], spans[:, 1] - spans[:, 0]
        owner = np.searchsorted(borders, starts, "right") - 1
        own = sums.words(buffer, starts, lengths)
        carried = 0
        if tail is not None:
            carried = len(tail[0])
            own, owner, lengths = (np.concatenate(x) for x in zip(tail, (own, owner, lengths)))
        tail = tuple(x[max(0, len(x) - scheme.longest + 1) :] for x in (own, owner, lengths))
        run = own
        for n in range(1, scheme.longest + 1):
            if n > 1:
                if len(own) < n:
                    break
                run = sums.joined(sums.spaced(run[:-1]), own[n - 1 :], lengths[n - 1 :])
            # An n-gram counts in the part that its last word belongs to, if it has one text.
            new = np.arange(len(run)) + n - 1 >= carried
            new &= owner[: len(run)] == owner[n - 1 :]
            yield n, owner[: len(run)][new], (run[new] % np.uint32(scheme.buckets)).astype(np.int64)


def bucket_counts(docs: DataFrame, text: str, scheme: Scheme):
    """How many features of all whole texts fall into each bucket, as an array."""
    import numpy as np

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums, total = Checksums(), np.zeros(scheme.buckets, np.int64)
        for batch in batches:
            texts = [v or "" for v in batch.column(0).to_pylist()]
            for a, b in chunks([len(t) for t in texts]):
                for _, _, own in features(texts[a:b], scheme, sums):
                    total += np.bincount(own, minlength=scheme.buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["bucket", "n"])

    rows = docs.select(quoted(text)).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(scheme.buckets, np.int64)
    for r in rows.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source, target, scheme: Scheme):
    """Whole thousandths of the log ratio of both smoothed frequencies, per bucket."""
    import numpy as np

    s, t = source.astype(np.float64), target.astype(np.float64)
    ratio = (t + 1) * (s.sum() + scheme.buckets) / ((s + 1) * (t.sum() + scheme.buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weigh(docs: DataFrame, text: str, gain, scheme: Scheme, keep: Sequence[str]) -> DataFrame:
    """The columns ``keep`` of every row with its ``n_words``, ``n_features`` and ``weight``."""
    kept = [docs.schema[k] for k in keep]
    schema = T.StructType([*kept, *(T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight"))])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        sums = Checksums()
        for batch in batches:
            texts = [v or "" for v in batch.column(len(keep)).to_pylist()]
            words, count, weight = (np.zeros(len(texts), np.int64) for _ in range(3))
            for a, b in chunks([len(t) for t in texts]):
                for n, owner, own in features(texts[a:b], scheme, sums):
                    met = np.bincount(owner, minlength=b - a)
                    count[a:b] += met
                    if n == 1:
                        words[a:b] += met
                    # Sums of whole numbers: exact in doubles, whatever their order.
                    weight[a:b] += np.bincount(owner, gain[own], b - a).astype(np.int64)
            columns = [*batch.columns[: len(keep)], *map(pa.array, (words, count, weight))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(*map(quoted, keep), quoted(text).alias("_text_")).mapInArrow(run, schema)


def gumbel(key: Column, seed: str) -> Column:
    """Whole thousandths of a Gumbel draw from the hash of seed and key; a null key is the empty one."""
    named = F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    scheme: Scheme = Scheme(),
    keep: Sequence[str] = (),
) -> DataFrame:
    """``key``, the columns ``keep``, ``n_words, n_features, weight, score`` and ``rank`` of every row.

    ``rank`` counts the drawn rows from 1 by falling score, ties by smaller key (null keys
    last); it is null for the others. Null texts are read as empty: no features, weight 0.
    Repeated keys are rows of their own with equal noise; rows equal in score and key take
    their ranks in any order. An empty target leaves the smoothed source alone to weigh, an
    empty table gives no rows. Columns outside ``keep`` are not read; a clash of ``key`` or
    ``keep`` with a new name raises.
    """
    columns = [key, *keep]
    new = {"n_words", "n_features", "weight", "score", "rank", "_text_"}
    if clash := new & {c.lower() for c in columns}:
        raise ValueError(f"the documents already have {sorted(clash)}")
    source = bucket_counts(docs, text, scheme)
    gain = gains(source, bucket_counts(target, target_text, scheme), scheme)
    weighed = weigh(docs, text, gain, scheme, columns)
    scored = publish(weighed.withColumn("score", F.col("weight") + gumbel(quoted(key), scheme.seed)))
    enough = F.col("n_words") >= scheme.least_words
    drawn = scored.where(enough).count() * scheme.percent // 100
    ranked = ordinal(scored.where(enough), [], [-F.col("score"), quoted(key).isNull(), quoted(key)], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long")))


OP12_SQL = f"""WITH {_CRC_SQL},
texts AS (SELECT 0 AS side, row_number() OVER () AS row, doc_id, text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
listed AS (SELECT side, row, regexp_extract_all(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts),
runs AS (SELECT side, row, w, len(w) AS n_words, unnest(range(1, len(w) + 1)) AS i FROM listed),
grams AS (SELECT side, row, w[i] AS feature FROM runs
  UNION ALL SELECT side, row, w[i] || ' ' || w[i + 1] FROM runs WHERE i + 1 <= n_words
  UNION ALL SELECT side, row, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM runs WHERE i + 2 <= n_words),
own AS (SELECT side, row, feature, count(*) AS n FROM grams GROUP BY ALL),
hashed AS (SELECT feature, {crc_sql("feature")} % 10000 AS bucket FROM (SELECT DISTINCT feature FROM own), crc),
cells AS (SELECT side, row, bucket, sum(n) AS n FROM own JOIN hashed USING (feature) GROUP BY ALL),
totals AS (SELECT CAST(sum(n) FILTER (WHERE side = 0) AS DOUBLE) AS s_all,
  CAST(sum(n) FILTER (WHERE side = 1) AS DOUBLE) AS t_all FROM cells),
gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(sum(n) FILTER (WHERE side = 1), 0) + 1.0::DOUBLE)
  * (coalesce(max(s_all), 0) + 10000) / ((coalesce(sum(n) FILTER (WHERE side = 0), 0) + 1.0::DOUBLE)
  * (coalesce(max(t_all), 0) + 10000)))) AS BIGINT) AS gain FROM cells, totals GROUP BY bucket),
weights AS (SELECT row, sum(n) AS n_features, sum(n * gain) AS weight FROM cells JOIN gain USING (bucket)
  WHERE side = 0 GROUP BY row),
scored AS (SELECT t.doc_id, len(l.w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features,
  CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST(coalesce(weight, 0) AS BIGINT) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' ||
    coalesce(CAST(t.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM texts t JOIN listed l USING (side, row) LEFT JOIN weights USING (row) WHERE t.side = 0),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS r,
  count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 5 * n // 100 THEN r END AS rank FROM ranked
UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM scored WHERE n_words < 20"""


@query(sql=OP12_SQL)
def op12_batch_concatenation(spark, sf_dir):
    """Every document's importance weight towards the benchmark texts, and the drawn ones' ranks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    target = table(spark, sf_dir, "benchmark").select("text")
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
