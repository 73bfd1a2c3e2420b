"""Audits of what would once have been lost without a word, and identity values in full."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairmatch import fixed_values as fixed
from pairmatch.catalogue.registry import query
from pairmatch.functions.evidence import item_cards
from pairmatch.functions.text import with_comparison_values, with_normalized
from pairmatch.operators import audits, mining, summaries
from pairmatch.plans.ensemble import request_contract
from pairmatch.session import spread
from pairmatch.sources import views

# Five brand keys, a value over 96 and one over 512 characters, from the part table.
_MANY = """'{"brand":"' || p_brand || '","brand a":"' || p_brand || ' ' || p_type || '","brand b":"lot ' || p_size
  || '","brand c":"' || p_type || '","manufacturer":"' || p_name || '","brand d":"' || p_brand
  || '","model":"' || repeat(p_name || ' ', 8) || '","article":"' || repeat(p_name || ' ', 60) || '"}'"""
_PLAIN = f"trim(regexp_replace(lower({{}}), '[^{fixed.WORD_CHARACTERS}]+', ' ', 'g'))"


def _plain(column: str) -> str:
    return _PLAIN.format(column)


@query(
    f"""WITH lists AS (SELECT p_partkey AS id,
      list_sort(list_distinct([{', '.join(map(_plain, ("p_brand", "p_brand || ' ' || p_type", "'lot ' || p_size", "p_type", "p_name")))}])) AS brand,
      [{_plain("repeat(p_name || ' ', 8)")}] AS model, [{_plain("repeat(p_name || ' ', 60)")}] AS article FROM part),
    flat AS (SELECT id, 'brand' AS identity_group, brand AS vals FROM lists
      UNION ALL SELECT id, 'model', model FROM lists UNION ALL SELECT id, 'article', article FROM lists)
    SELECT id, identity_group, CAST(len(vals) AS BIGINT) AS distinct_values,
      CAST(length(array_to_string(vals, '|')) AS BIGINT) AS characters, md5(array_to_string(vals, '|')) AS digest
    FROM flat"""
)
def identity_groups_full(spark, sf_dir):
    """Four and more values in a group, and values over 96 and 512 characters: all of them whole."""
    items = views.table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id", "p_name AS name", "p_type AS category", f"{_MANY} AS attributes"
    )
    names = list(fixed.IDENTITY_GROUPS)
    listed = [
        F.struct(F.lit(n).alias("identity_group"), F.get("identity", names.index(n)).alias("vals"))
        for n in ("brand", "model", "article")
    ]
    flat = item_cards(items).select("id", F.inline(F.array(*listed)))
    joined = F.array_join("vals", "|")
    return flat.select(
        "id",
        "identity_group",
        F.size("vals").alias("distinct_values"),
        F.length(joined).alias("characters"),
        F.md5(joined).alias("digest"),
    )


# Measures in several spellings, and what each is in its base unit.
_MEASURES = {
    "p_size || 'мл'": "p_size || ' ml'",
    "p_size || ',5 л'": "(p_size * 1000 + 500) || ' ml'",
    "p_size || ' миллилитров'": "p_size || ' ml'",
    "p_size || '.50 см'": "(p_size * 10 + 5) || ' mm'",
    "'0,' || (p_size % 9 + 1) || ' метра'": "(p_size % 9 + 1) * 100 || ' mm'",
    "p_size || 'шт'": "p_size || ' pcs'",
    "p_size || ' штук'": "p_size || ' pcs'",
    "'00' || p_size || ' кг'": "p_size * 1000 || ' g'",
    "'x' || p_size || 'мл'": "'x' || p_size || 'мл'",
    "'A-' || p_size": "'a ' || p_size",
}


@query(
    "SELECT p_partkey AS id, unnest(range("
    + f"{len(_MEASURES)})) AS spelling, unnest(["
    + ", ".join(_MEASURES.values())
    + "]) AS compared FROM part"
)
def unit_values(spark, sf_dir):
    """Litres, grams, lengths and pieces in base units, and what is no measure left alone."""
    rows = views.table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id", f"array({', '.join(_MEASURES)}) AS spelt"
    )
    folded = spread(rows).select("id", F.posexplode("spelt").alias("spelling", "value"))
    normal = with_normalized(folded, {"value": F.col("value")})
    compared = with_comparison_values(normal, "values", F.array("value"))
    return compared.select("id", "spelling", F.element_at("values", 1).alias("compared"))


_GAPS = """CASE WHEN id1 % 13 = 0 THEN NULL ELSE category END AS category,
CASE WHEN id1 % 11 = 0 THEN NULL WHEN id1 % 7 = 0 THEN CAST('NaN' AS DOUBLE) ELSE score_a END AS score_a"""


@query(
    views.with_views(
        ["scored"],
        f"gaps AS (SELECT {_GAPS} FROM scored)",
        query="""SELECT count(*) AS rows, count(*) FILTER (category IS NULL) AS null_key_rows,
        count(*) FILTER (score_a IS NULL) AS null_score_a_rows,
        count(*) FILTER (isnan(score_a)) AS nan_score_a_rows FROM gaps""",
    )
)
def rank_null_audit(spark, sf_dir):
    """Rows that every ranking and metric refuses."""
    gaps = views.scored(spark, sf_dir).selectExpr(*_GAPS.split(",\n"))
    return audits.rank_inputs(gaps, ["category"], ["score_a"])


@query(
    views.with_views(
        ["scored"],
        "known AS (SELECT DISTINCT category FROM scored WHERE target <= 0.2 AND score_b > 0.9 AND id1 % 5 = 0)",
        query="""SELECT category, count(*) AS rows FROM scored
        WHERE category NOT IN (SELECT category FROM known WHERE category <> 'AF') GROUP BY category""",
    )
)
def stress_missing_threshold_audit(spark, sf_dir):
    """Categories of the rows for which no threshold was fitted."""
    rows = views.scored(spark, sf_dir)
    fit = rows.where("target <= 0.2 and score_b > 0.9 and id1 % 5 = 0 and category <> 'AF'")
    thresholds = summaries.hard_pair_thresholds(fit)
    return audits.uncovered_categories(rows, thresholds)


@query(
    views.with_views(
        ["soft_pairs"],
        """rows AS (SELECT i.category, count(*) AS available FROM soft_pairs p JOIN items i ON i.id = p.id1
          WHERE i.category <> 'PROMO' GROUP BY 1)""",
        """asked AS (SELECT DISTINCT category, CAST(100000000 AS BIGINT) AS quota FROM items
          WHERE category <> 'SMALL')""",
        query="""SELECT category, quota, coalesce(available, 0) AS available,
        greatest(coalesce(quota, 0) - coalesce(available, 0), 0) AS missing
        FROM rows FULL JOIN asked USING (category)""",
    )
)
def quota_shortfall_audit(spark, sf_dir):
    """Quotas that the rows can't fill, a category without rows and one without a quota."""
    cards = views.items(spark, sf_dir)
    pairs = views.soft_pairs(spark, sf_dir).join(cards.select(F.col("id").alias("id1"), "category"), "id1")
    asked = cards.where("category <> 'SMALL'").select("category").distinct()
    return mining.quota_shortfall(
        pairs.where("category <> 'PROMO'"), asked.withColumn("quota", F.lit(100_000_000).cast("long"))
    )


@query(
    views.with_views(
        ["human_pairs"],
        """request AS (SELECT id1, id2 FROM human_pairs
          UNION ALL SELECT id1, id2 FROM human_pairs WHERE id1 % 3 = 0
          UNION ALL SELECT id1, -id2 FROM human_pairs WHERE id1 % 4 = 0
          UNION ALL SELECT id1, id1 + 1 FROM human_pairs WHERE id1 % 10 = 0)""",
        """known AS (SELECT id, category FROM items),
        ends AS (SELECT r.*, a.id AS l, b.id AS r, a.category AS cl, b.category AS cr FROM request r
          LEFT JOIN known a ON a.id = r.id1 LEFT JOIN known b ON b.id = r.id2)""",
        query="""SELECT CAST((SELECT count(*) FROM request) AS BIGINT) AS requested_rows,
        CAST((SELECT count(*) FROM request) - (SELECT count(*) FROM (SELECT DISTINCT id1, id2 FROM request)) AS BIGINT) AS repeated_rows,
        CAST(count(*) FILTER (l IS NULL OR r IS NULL) AS BIGINT) AS unknown_item_rows,
        CAST(count(*) FILTER (l IS NOT NULL AND r IS NOT NULL AND cl IS DISTINCT FROM cr) AS BIGINT) AS cross_category_rows,
        CAST((SELECT count(*) FROM items WHERE id % 100 = 7) AS BIGINT) AS null_ids,
        CAST((SELECT count(*) FROM items WHERE id % 50 = 3) AS BIGINT) AS duplicate_ids FROM ends""",
    )
)
def predict_contract_audit(spark, sf_dir):
    """What a prediction request must not hold: planted repeats, unknown items, mixed pairs."""
    pairs, cards = views.human_pairs(spark, sf_dir).select("id1", "id2"), views.items(spark, sf_dir)
    parts = [
        pairs,
        pairs.where("id1 % 3 = 0"),
        pairs.where("id1 % 4 = 0").withColumn("id2", -F.col("id2")),
        pairs.where("id1 % 10 = 0").withColumn("id2", F.col("id1") + 1),
    ]
    planted = [
        cards,
        cards.where("id % 100 = 7").withColumn("id", F.lit(None).cast("long")),
        cards.where("id % 50 = 3"),
    ]
    return request_contract(summaries.stack(parts), summaries.stack(planted))
