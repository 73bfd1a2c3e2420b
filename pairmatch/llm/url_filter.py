"""Url filters: listed rules first, then trust and distrust propagated over the host graph.

Trust starts at hosts whose pages the rules allow and follows links: who is linked from
trusted hosts earns trust. Distrust starts at hosts whose pages the rules block and follows
links backwards: who links to blocked hosts earns distrust. Both are personalised PageRank
vectors over the same host edges, run side by side in one table of (kind, host, mass).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmatch.llm.common import fresh, query, quoted, table, whole
from pairmatch.session import settle

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Host names in a page: at least two labels, the last of letters.
HOST_NAME = r"(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"
#: The same in two steps that take linear time and no stack: rows of labels from their first
#: character on, then each up to its last label that begins with two letters.
LABELS = r"(?<![A-Za-z0-9-])[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
ENDING = r"^.*\.[A-Za-z]{2,}"


@dataclass(frozen=True)
class Rule:
    """``host`` with all its subdomains, for paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of op9, from the task.
RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; a null url or one without ``://`` has both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(raw, UPPER, UPPER.lower()), path


def match_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest fitting rule, nulls without one. Equal lengths: the first listed."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text = F.when(fits, rule.text).otherwise(text)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def site_edges(hosts: DataFrame) -> DataFrame:
    """Edges both ways between a host and its nearest parent domains that are hosts themselves."""
    child = hosts.select(
        F.col("host").alias("src"),
        F.explode(
            F.transform(
                F.sequence(F.lit(2), F.greatest(F.size(F.split("host", r"\.")), F.lit(2))),
                lambda i: F.concat_ws(".", F.slice(F.split("host", r"\."), i, F.size(F.split("host", r"\.")))),
            )
        ).alias("dst"),
    )
    up = child.where("src <> dst").join(hosts.select(F.col("host").alias("dst")), "dst").select("src", "dst")
    return up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def link_edges(pages: DataFrame, host: str, html: str, hosts: DataFrame) -> DataFrame:
    """Distinct edges from a page's host to the other hosts that its links or its text name."""
    rows = F.regexp_extract_all(whole(quoted(html)), F.lit(LABELS), F.lit(0))
    named = F.explode(F.array_distinct(F.transform(rows, lambda r: F.regexp_extract(r, ENDING, 0))))
    found = pages.select(quoted(host).alias("src"), named.alias("dst"))
    return (
        found.select("src", F.translate("dst", UPPER, UPPER.lower()).alias("dst"))
        .where("src <> '' and dst <> '' and src <> dst")
        .distinct()
        .join(hosts.select(F.col("host").alias("dst")), "dst")
        .select("src", "dst")
    )


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 12) -> DataFrame:
    """``host, trust, distrust`` after a fixed number of PageRank rounds.

    After ``rounds`` rounds at most ``damping ** rounds`` of the mass would still move (0.14 by default).

    ``edges(src, dst)`` are distinct, ``seeds(host, trust, distrust)`` non-negative weights.
    A host hands ``damping`` of its mass in equal parts to its neighbours (forward for
    trust, backward for distrust); a host without any lets it go, which needs no global
    sum. Each round is one join and one combined sum on hosts; every fourth is checkpointed.
    """
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"))
    )
    parts = both.groupBy("kind", "src").agg((F.lit(damping) / F.count(F.lit(1))).alias("part"))
    routes = settle(
        both.join(parts, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", "part")
    )
    total = seeds.agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")).first()
    start = settle(
        seeds.select(
            "host",
            F.explode(
                F.create_map(
                    F.lit("trust"),
                    F.col("trust") / F.lit((total["trust"] or 0.0) or 1.0),
                    F.lit("distrust"),
                    F.col("distrust") / F.lit((total["distrust"] or 0.0) or 1.0),
                )
            ).alias("kind", "mass"),
        ).where("mass > 0")
    )
    restart = start.select("kind", "host", (F.col("mass") * (1 - damping)).alias("mass"))
    state = start
    for n in range(rounds):
        sent = state.join(routes, ["kind", "host"]).select(
            "kind", F.col("dst").alias("host"), (F.col("mass") * F.col("part")).alias("mass")
        )
        state = sent.unionByName(restart).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
        if n % 4 == 3:
            state = settle(state)
    return state.groupBy("host").agg(
        *[
            F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("mass"))), F.lit(0.0)).alias(kind)
            for kind in ("trust", "distrust")
        ]
    )


def judge_urls(
    pages: DataFrame,
    url: str = "url",
    html: str = "html",
    rules: Sequence[Rule] = RULES,
    least_trust: float = 0.5,
    parents: bool = False,
) -> DataFrame:
    """Add ``host, path, rule, trust_share, verdict`` to every page.

    The longest fitting rule decides. Elsewhere the host's share
    ``trust / (trust + distrust)`` does: under ``least_trust`` the page is blocked, a host
    that neither vector reaches is allowed (share null). A host's seed weights are its
    numbers of allowed and blocked pages. With ``parents`` a host also has edges both ways with
    its parent domains that are hosts. Pages with a null or unusable url have empty host
    and path and are allowed; repeated pages each count and each get a row; other columns
    are kept, a clash with a new name raises.
    """
    added = ("host", "path", "rule", "trust_share", "verdict")
    if clash := set(added) & {c.lower() for c in pages.columns}:
        raise ValueError(f"the pages already have {sorted(clash)}")
    host, path = host_and_path(quoted(url))
    told = fresh(pages.columns, "_told")

    def ruled(df: DataFrame) -> DataFrame:
        df = df.withColumns({"host": host, "path": path})
        rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
        return df.withColumns({"rule": rule, told: verdict})

    counts = settle(
        ruled(pages.select(quoted(url)))
        .groupBy("host")
        .agg(
            F.count_if(F.col(told) == "allow").cast("double").alias("trust"),
            F.count_if(F.col(told) == "block").cast("double").alias("distrust"),
        )
    )
    hosts = counts.where("host <> ''").select("host")
    named = pages.select(host.alias("host"), quoted(html).alias("html"))
    edges = link_edges(named, "host", "html", hosts)
    edges = settle(edges.unionByName(site_edges(hosts)).distinct() if parents else edges)
    shares = propagate(edges, counts.where("host <> ''")).select(
        "host", F.round(F.col("trust") / (F.col("trust") + F.col("distrust")), 9).alias("trust_share")
    )
    return (
        ruled(pages)
        .join(shares, "host", "left")
        .select(
            *map(quoted, pages.columns),
            "host",
            "path",
            "rule",
            "trust_share",
            F.coalesce(
                F.col(told),
                F.when(F.col("trust_share") < least_trust, "block").otherwise("allow"),
            ).alias("verdict"),
        )
    )


def _rule_sql(rules: Sequence[Rule]) -> str:
    cases = []
    for pick in ("text", "verdict"):
        whens = " ".join(
            f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
            f" THEN '{getattr(r, pick)}'"
            for r in sorted(rules, key=lambda r: -len(r.text))
        )
        cases.append(f"CASE {whens} END AS {'rule' if pick == 'text' else 'told'}")
    return ", ".join(cases)


def _rounds_sql(rounds: int = 12, damping: float = 0.85) -> str:
    text = "m0 AS (SELECT * FROM start)"
    for n in range(1, rounds + 1):
        text += f""",
m{n} AS (SELECT kind, host, sum(mass) AS mass FROM (
  SELECT m.kind, r.dst AS host, m.mass * r.part AS mass FROM m{n - 1} m JOIN routes r USING (kind, host)
  UNION ALL SELECT kind, host, mass * (1 - {damping}) FROM start) GROUP BY kind, host)"""
    return text


OP9_SQL = f"""WITH cut AS (SELECT page_id, html, CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN ''
  ELSE substr(url, instr(url, '://') + 3) END AS rest FROM pages),
named AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut),
placed AS (SELECT page_id, html, translate(raw, '{UPPER}', '{UPPER.lower()}') AS host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM named),
ruled AS (SELECT *, {_rule_sql(RULES)} FROM placed),
counts AS (SELECT host, CAST(count(*) FILTER (told = 'allow') AS DOUBLE) AS trust,
  CAST(count(*) FILTER (told = 'block') AS DOUBLE) AS distrust FROM ruled WHERE host <> '' GROUP BY host),
links AS (SELECT host AS src, translate(unnest(list_distinct(regexp_extract_all(html, '{HOST_NAME}'))),
  '{UPPER}', '{UPPER.lower()}') AS dst FROM placed),
edges AS (SELECT DISTINCT src, dst FROM links JOIN counts ON counts.host = dst WHERE src <> '' AND src <> dst),
both_ways AS (SELECT 'trust' AS kind, src AS host, dst FROM edges
  UNION ALL SELECT 'distrust', dst, src FROM edges),
routes AS (SELECT kind, host, dst, 0.85 / count(*) OVER (PARTITION BY kind, host) AS part FROM both_ways),
sums AS (SELECT sum(trust) AS t, sum(distrust) AS d FROM counts),
start AS (SELECT 'trust' AS kind, host, trust / t AS mass FROM counts, sums WHERE trust > 0
  UNION ALL SELECT 'distrust', host, distrust / d FROM counts, sums WHERE distrust > 0),
{_rounds_sql()},
shares AS (SELECT host, round(sum(mass) FILTER (kind = 'trust') / sum(mass), 9) AS share,
  coalesce(sum(mass) FILTER (kind = 'trust'), 0) AS trust FROM m12 GROUP BY host)
SELECT page_id, host, path, rule, coalesce(told,
  CASE WHEN shares.host IS NOT NULL AND coalesce(share, 0) < 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled LEFT JOIN shares USING (host)"""


@query(sql=OP9_SQL)
def op9_link_graph(spark, sf_dir):
    """Every page's host, path, rule and verdict."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")
