"""Text normalisation, attributes, item texts and pair evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairmatch import fixed_values as fixed
from pairmatch.catalogue.registry import query, real, whole
from pairmatch.functions import attributes as A
from pairmatch.functions import evidence as E
from pairmatch.functions import text as X
from pairmatch.operators.joins import pair_cards
from pairmatch.operators.scoring import evidence_table
from pairmatch.session import settle, spread
from pairmatch.sources import views

# The documents hold no composed or compatibility characters, so lower-casing and the
# sharp s are all that NFKC case folding does to them.
NORMAL_SQL = r"""trim(regexp_replace(replace(replace(lower({0}), 'ß', 'ss'), 'ё', 'е'),
  '[\x00-\x20\x7F]+', ' ', 'g'))"""


@query(
    f"""SELECT doc_id, length(t) AS characters, md5(t) AS digest FROM
    (SELECT doc_id, {NORMAL_SQL.format('text')} AS t FROM documents)"""
)
def normalised_documents(spark, sf_dir):
    documents = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    folded = X.with_normalized(documents, {"t": F.col("text")})
    return folded.select("doc_id", F.length("t").alias("characters"), F.md5("t").alias("digest"))


_IDENTIFIERS_SQL = f"""list_sort(list_distinct(list_filter(list_transform(list_filter(
  regexp_extract_all(t, '[{fixed.IDENTIFIER_CHARACTERS}]+'), lambda x: regexp_matches(x, '[0-9]')),
  lambda x: regexp_replace(x, '[^{fixed.WORD_CHARACTERS}]+', '', 'g')),
  lambda x: length(x) >= 3)))"""


@query(
    f"""SELECT doc_id, CAST(len(ids) AS BIGINT) AS identifiers, array_to_string(ids, '|') AS listed
    FROM (SELECT doc_id, {_IDENTIFIERS_SQL} AS ids FROM
    (SELECT doc_id, {NORMAL_SQL.format('text')} AS t FROM documents))"""
)
def title_identifiers(spark, sf_dir):
    """Identifiers of whole documents, read as titles."""
    documents = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    folded = X.with_normalized(documents, {"t": F.col("text")})
    found = folded.select("doc_id", X.title_identifiers(F.col("t")).alias("ids"))
    return found.select(
        "doc_id", F.size("ids").alias("identifiers"), F.array_join("ids", "|").alias("listed")
    )


@query()
def normalised_measures(spark, sf_dir):
    """Comparison form of whole documents; DuckDB's regular expressions lack look-around."""
    documents = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    folded = X.with_normalized(documents, {"t": F.col("text")})
    compared = X.with_comparison_values(folded, "c", F.array("t"))
    value = F.element_at("c", 1)
    return compared.select("doc_id", F.length(value).alias("characters"), F.md5(value).alias("digest"))


_STATE_SQL = """CASE WHEN attributes IS NULL OR attributes = '' THEN 'missing'
  WHEN NOT json_valid(attributes) THEN 'malformed'
  WHEN json_type(attributes) <> 'OBJECT' THEN 'malformed'
  WHEN len(json_keys(attributes)) = 0 THEN 'empty' ELSE 'present' END"""


def _parsed(spark, sf_dir):
    return A.with_attributes(spread(views.items(spark, sf_dir)), F.col("attributes"))


@query(
    views.with_views(
        ["items"],
        f"states AS (SELECT category, {_STATE_SQL} AS state FROM items)",
        query="SELECT category, state, count(*) AS rows FROM states GROUP BY ALL",
    )
)
def attribute_states(spark, sf_dir):
    return _parsed(spark, sf_dir).groupBy("category", "state").agg(F.count(F.lit(1)).alias("rows"))


_PRIORITY_SQL = (
    "CASE "
    + " ".join(
        f"WHEN contains(key, '{fragment}') THEN {i}"
        for i, fragment in enumerate(fixed.PRIORITY_FRAGMENTS)
    )
    + f" ELSE {len(fixed.PRIORITY_FRAGMENTS)} END"
)
# Keys and values of the fixture are ASCII, flat and short.
ENTRIES_SQL = f"""present AS (SELECT id, name, category, attributes, {_STATE_SQL} AS state FROM items),
raw_entries AS (SELECT id, attributes, unnest(json_keys(attributes)) AS raw_key FROM present
  WHERE state = 'present'),
entries AS (SELECT id, lower(raw_key) AS key, lower(json_extract_string(attributes, '$.' || raw_key)) AS value
  FROM raw_entries),
ordered AS (SELECT id, key, value, row_number() OVER (PARTITION BY id
  ORDER BY {_PRIORITY_SQL}, key, value) AS pos FROM entries)"""


@query(
    views.with_views(
        ["items"],
        ENTRIES_SQL,
        query="SELECT id, pos AS position, key, value FROM ordered",
    )
)
def attribute_pairs(spark, sf_dir):
    return _parsed(spark, sf_dir).select(
        "id", F.posexplode("attributes_sorted").alias("position", "entry")
    ).select("id", (F.col("position") + 1).alias("position"), "entry.key", "entry.value")


def lines_sql(separator: str, budget: int, out: str = "lined") -> str:
    """CTE ``out(id, joined)``: attribute lines within a character budget."""
    return f"""{out}_spent AS (SELECT id, pos, key || '{separator}' || value AS line, {budget} - coalesce(
  sum(length(key || '{separator}' || value)) OVER (PARTITION BY id ORDER BY pos
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM ordered),
{out} AS (SELECT id, list(left(line, CAST(room AS BIGINT)) ORDER BY pos) AS lines
  FROM {out}_spent WHERE room > 0 GROUP BY id)"""


ITEM_TEXT_SQL = """'категория: ' || lower(i.category) || chr(10) || 'название: ' || lower(i.name)
  || CASE WHEN l.lines IS NULL THEN '' ELSE chr(10) || array_to_string(l.lines, chr(10)) END"""


def item_texts_sql(budget: int, out: str = "texts") -> str:
    return f"""{lines_sql(': ', budget, out + '_lines')},
{out} AS (SELECT i.id, i.category, i.name, {ITEM_TEXT_SQL} AS text
  FROM items i LEFT JOIN {out}_lines l ON l.id = i.id)"""


@query(
    views.with_views(
        ["items"],
        ENTRIES_SQL,
        item_texts_sql(fixed.ATTRIBUTE_BUDGET),
        query="SELECT id, text FROM texts",
    )
)
def item_text(spark, sf_dir):
    return A.with_item_text(views.items(spark, sf_dir)).select("id", "text")


@query(
    views.with_views(
        ["items"],
        ENTRIES_SQL,
        item_texts_sql(31),
        query="""SELECT id, 'Same variant?' || chr(10) || chr(10) || text AS query FROM texts""",
    )
)
def model_query(spark, sf_dir):
    """Instruction mode, with a budget that cuts inside an attribute."""
    texts = A.with_item_text(views.items(spark, sf_dir), budget=31)
    return texts.select("id", A.model_query(F.col("text"), "exact", "Same variant?").alias("query"))


_GROUP_SQL = (
    "CASE "
    + " ".join(
        "WHEN " + " OR ".join(f"contains(key, '{f}')" for f in fragments) + f" THEN '{name}'"
        for name, fragments in fixed.IDENTITY_GROUPS.items()
    )
    + " END"
)
# The fixture's measures are whole millimetres, already in base form.
IDENTITY_SQL = f"""compared AS (SELECT id, {_GROUP_SQL} AS grp,
  trim(regexp_replace(value, '[^{fixed.WORD_CHARACTERS}]+', ' ', 'g')) AS value FROM ordered),
identity AS (SELECT id, grp, list_sort(list_distinct(list(value))) AS vals
  FROM compared WHERE grp IS NOT NULL AND value <> '' GROUP BY id, grp)"""


@query(
    views.with_views(
        ["items"],
        ENTRIES_SQL,
        IDENTITY_SQL,
        query="SELECT id, grp AS identity_group, array_to_string(vals, '|') AS listed FROM identity",
    )
)
def identity_groups(spark, sf_dir):
    cards = E.item_cards(views.items(spark, sf_dir))
    names = F.array(*[F.lit(n) for n in fixed.IDENTITY_GROUPS])
    listed = cards.select(
        "id", F.explode(F.arrays_zip(names.alias("name"), F.col("identity").alias("vals"))).alias("g")
    )
    return listed.where(F.size("g.vals") > 0).select(
        "id", F.col("g.name").alias("identity_group"), F.array_join("g.vals", "|").alias("listed")
    )


@query(
    views.with_views(
        ["items"],
        ENTRIES_SQL,
        IDENTITY_SQL,
        query="SELECT id, key, c.value AS compared FROM ordered o JOIN compared c USING (id) WHERE"
        " trim(regexp_replace(o.value, '[^0-9a-zа-я]+', ' ', 'g')) = c.value"
        f" AND {_GROUP_SQL} IS NOT DISTINCT FROM c.grp",
    )
)
def unit_normalised_values(spark, sf_dir):
    parsed = _parsed(spark, sf_dir)
    compared = X.with_comparison_values(
        parsed, "compared", F.transform("attributes_sorted", lambda e: e.value)
    )
    return compared.select(
        "id", F.explode(F.arrays_zip("attributes_sorted", "compared")).alias("z")
    ).select("id", "z.attributes_sorted.key", "z.compared")


# Titles of the fixture hold no digits, so title identifiers add no evidence.
_GROUP_ORDER = ", ".join(f"('{name}', {i})" for i, name in enumerate(fixed.IDENTITY_GROUPS))
EVIDENCE_SQL = f"""group_order(grp, place) AS (VALUES {_GROUP_ORDER}),
pair_groups AS (SELECT p.id1, p.id2, g.grp, g.place, coalesce(l.vals, []) AS lv, coalesce(r.vals, []) AS rv
  FROM pairs p CROSS JOIN group_order g LEFT JOIN identity l ON l.id = p.id1 AND l.grp = g.grp
  LEFT JOIN identity r ON r.id = p.id2 AND r.grp = g.grp),
judged AS (SELECT *, list_sort(list_intersect(lv, rv)) AS shared,
  array_to_string(lv, '|') AS lj, array_to_string(rv, '|') AS rj FROM pair_groups),
evidence AS (SELECT id1, id2,
  coalesce(string_agg(grp || '=' || array_to_string(shared, '|'), '; ' ORDER BY place)
    FILTER (WHERE len(shared) > 0), 'none') AS matches,
  coalesce(string_agg(grp || '=' || least(lj, rj) || '<>' || greatest(lj, rj), '; ' ORDER BY place)
    FILTER (WHERE len(shared) = 0 AND len(lv) > 0 AND len(rv) > 0), 'none') AS conflicts,
  coalesce(string_agg(grp, ',' ORDER BY place)
    FILTER (WHERE (len(lv) > 0) <> (len(rv) > 0)), 'none') AS missing,
  count(*) FILTER (WHERE len(shared) > 0) AS identity_matches,
  count(*) FILTER (WHERE len(shared) = 0 AND len(lv) > 0 AND len(rv) > 0) AS identity_conflicts,
  count(*) FILTER (WHERE (len(lv) > 0) <> (len(rv) > 0)) AS missing_identity_fields
  FROM judged GROUP BY id1, id2)"""


def evidence_ctes(pairs: str) -> tuple[str, ...]:
    return (
        f"pairs AS (SELECT * FROM {pairs})",
        ENTRIES_SQL,
        IDENTITY_SQL,
        EVIDENCE_SQL,
    )


@query(
    views.with_views(
        ["human_pairs"],
        *evidence_ctes("human_pairs"),
        query="SELECT * FROM evidence",
    )
)
def pair_evidence(spark, sf_dir):
    # Both sides of every pair read the cards: parse the items once.
    cards = settle(E.item_cards(views.items(spark, sf_dir)).select("id", "category", *E.CARD_FIELDS))
    joined = pair_cards(views.human_pairs(spark, sf_dir), cards, E.CARD_FIELDS)
    found = E.with_evidence(joined)

    def listed(field: str, glue: str):
        text = F.array_join(F.col(field), glue)
        return F.when(text == "", F.lit("none")).otherwise(text).alias(field)

    return found.select(
        "id1",
        "id2",
        listed("matches", "; "),
        listed("conflicts", "; "),
        listed("missing", ","),
        F.size("matches").alias("identity_matches"),
        F.size("conflicts").alias("identity_conflicts"),
        F.size("missing").alias("missing_identity_fields"),
    )


_CARD_SQL = f"""{lines_sql(' [VALUE] ', fixed.ATTRIBUTE_BUDGET, 'marked')},
cards AS (SELECT p.id, p.category, lower(p.name) AS title, p.state,
  coalesce(m.lines, []) AS lines, array_to_string(list_concat(
    [lower(p.name), p.state], coalesce(m.lines, [])), chr(10)) AS sort_key
  FROM present p LEFT JOIN marked m ON m.id = p.id),
sided AS (SELECT e.*, l.category, r.sort_key < l.sort_key AS swap, l, r FROM evidence e
  JOIN cards l ON l.id = e.id1 JOIN cards r ON r.id = e.id2),
turned AS (SELECT *, CASE WHEN swap THEN r ELSE l END AS a, CASE WHEN swap THEN l ELSE r END AS b
  FROM sided)"""


@query(
    views.with_views(
        ["soft_pairs"],
        *evidence_ctes("soft_pairs"),
        _CARD_SQL,
        query="""SELECT id1, id2, array_to_string(list_concat(
        ['[CATEGORY] ' || lower(category), '[LEFT] [TITLE] ' || a.title,
         '[RIGHT] [TITLE] ' || b.title, '[MATCH] ' || matches, '[CONFLICT] ' || conflicts,
         '[MISSING_IDENTITY] ' || missing, '[LEFT] [ATTRIBUTES] ' || a.state,
         '[RIGHT] [ATTRIBUTES] ' || b.state],
        list_filter(flatten(list_transform(range(1, greatest(len(a.lines), len(b.lines)) + 1),
          lambda i: [ '[LEFT] [ATTR] ' || a.lines[i], '[RIGHT] [ATTR] ' || b.lines[i] ])),
          lambda x: x IS NOT NULL)), chr(10)) AS text FROM turned""",
    )
)
def pair_text_canonical(spark, sf_dir):
    table = evidence_table(views.soft_pairs(spark, sf_dir), views.items(spark, sf_dir), "pair")
    return table.select("id1", "id2", F.col("left_text").alias("text"))


@query(
    views.with_views(
        ["human_pairs"],
        *evidence_ctes("human_pairs"),
        item_texts_sql(fixed.ATTRIBUTE_BUDGET),
        query=f"""SELECT p.id1, p.id2, p.target, a.category, a.text AS left_text,
        b.text AS right_text, {real('jaccard(lower(a.name), lower(b.name))::FLOAT', 'surface_similarity')},
        {whole('identity_matches', 'identity_matches')},
        {whole('identity_conflicts', 'identity_conflicts')},
        {whole('missing_identity_fields', 'missing_identity_fields')}
        FROM human_pairs p JOIN texts a ON a.id = p.id1 JOIN texts b ON b.id = p.id2
        JOIN evidence e ON e.id1 = p.id1 AND e.id2 = p.id2""",
    )
)
def evidence_batch(spark, sf_dir):
    return evidence_table(views.human_pairs(spark, sf_dir), views.items(spark, sf_dir))
