"""Registered search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean
from ..operators import search
from ..registry import register
from ..sources.tables import Tables

K = 14
STOP = ", ".join(f"'{w}'" for w in clean.STOP_WORDS)
TOKENS_SQL = f"""
list_filter(list_distinct(flatten(list_transform(regexp_extract_all(lower(COALESCE(text, '')), '[a-z0-9]+'),
    lambda t: [t, CASE WHEN suffix(t, 'ies') THEN t[1:length(t) - 3] || 'y'
                       WHEN suffix(t, 's') AND NOT suffix(t, 'ss') THEN t[1:length(t) - 1] ELSE t END]))),
    lambda t: length(t) > 1 AND NOT list_contains([{STOP}], t))"""

EXTRA = {
    "docs_r": "SELECT doc_id, source || ' ' || lang AS area, text, source FROM documents",
    "qtok_r": f"SELECT item_id, unnest({TOKENS_SQL}) AS token FROM benchmark",
    "phrase_r": "SELECT item_id, regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g') AS phrase FROM benchmark",
}
EXTRA["scored_r"] = """
SELECT item_id, doc_id, sum(pts) AS score FROM (
  SELECT q.item_id, d.doc_id,
         (CASE WHEN contains(lower(d.area), q.token) THEN 3 ELSE 0 END)
         + (CASE WHEN contains(lower(d.text), q.token) THEN 1 ELSE 0 END) AS pts
  FROM qtok_r q, docs_r d
  UNION ALL
  SELECT p.item_id, d.doc_id, 5
  FROM phrase_r p, docs_r d
  WHERE length(p.phrase) > 4 AND contains(lower(d.area) || ' ' || lower(d.text), p.phrase))
GROUP BY item_id, doc_id HAVING sum(pts) > 0"""


def docs(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    return d.select("doc_id", F.concat_ws(" ", "source", "lang").alias("area"), "text", "source")


@register("f19_search_tokens", f"""
SELECT item_id, list_sort({TOKENS_SQL}) AS tokens FROM benchmark""")
def f19(spark, sf_dir):
    q = Tables(spark, sf_dir).benchmark
    return q.select("item_id", F.array_sort(clean.search_tokens("text")).alias("tokens"))


@register("d2_retrieve", f"""
SELECT r.item_id, r.rank, r.doc_id, d.area, r.score FROM (
  SELECT item_id, doc_id, CAST(score AS BIGINT) AS score,
         row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored_r) r
JOIN docs_r d ON d.doc_id = r.doc_id WHERE r.rank <= {K}
UNION ALL
SELECT b.item_id, f.rank, f.doc_id, d.area, CAST(0 AS BIGINT)
FROM benchmark b
JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rank FROM documents ORDER BY doc_id LIMIT 2) f ON true
JOIN docs_r d ON d.doc_id = f.doc_id
WHERE b.item_id NOT IN (SELECT item_id FROM scored_r)""", extra=EXTRA)
def d2(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return search.retrieve(t.benchmark, docs(spark, sf_dir), K)
