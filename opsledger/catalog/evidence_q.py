"""Registered evidence, validation, answer-log and text-cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import StagedLedger
from ..functions import clean
from ..operators import evidence, kpis, marts
from ..registry import register
from ..sources.tables import Tables
from .marts_q import V6_SQL
from .rules_q import EXTRA as RULE_EXTRA

EX = dict(RULE_EXTRA)
EX["v6_r"] = V6_SQL


def _list(vals):
    return "[" + ", ".join(f"'{v}'" for v in vals) + "]"


def _first(pairs, otherwise: str) -> str:
    return "COALESCE(" + ", ".join(f"CASE WHEN {cond} THEN {_list([d])} END" for cond, d in pairs) + f", {otherwise})"


_LISTED = "list_filter([" + ", ".join(
    [f"CASE WHEN list_contains({_list(names)}, entity_name) THEN '{d}' END" for d, names in evidence.DOMAIN_ENTITIES.items()]
    + [f"CASE WHEN contains(entity_name, '{evidence.AUCTION_WORD}') THEN 'auctions' END"]) + "], lambda x: x IS NOT NULL)"
_DOMAINS = _first([(f"entity_name = 'source_file' AND contains(lower(COALESCE(entity_key, '')), '{words}')", d) for words, d in evidence.FILE_WORDS],
                  f"CASE WHEN len({_LISTED}) > 0 THEN {_LISTED} ELSE {_list([evidence.NO_DOMAIN])} END")
_INV: dict[str, list[str]] = {}
for _v, _ds in evidence.VIEW_DOMAINS.items():
    for _d in _ds:
        _INV.setdefault(_d, []).append(_v)
_VIEWS_OF = "CASE d " + " ".join(f"WHEN '{d}' THEN {_list(vs)}" for d, vs in _INV.items()) + " ELSE [] END"
EX["page_issues_r"] = f"""
SELECT *, CASE WHEN regexp_matches(rule_code, '^(MISSING_|UNMAPPED_|INVALID_NUMBER)') THEN 'incomplete'
               WHEN severity = 'info' THEN 'verified' ELSE 'flagged' END AS trust
FROM (SELECT *, unnest(list_distinct(flatten(list_transform(
        {_DOMAINS},
        lambda d: {_VIEWS_OF})))) AS view
      FROM issues_r)"""


def issues(spark, sf_dir):
    from .rules_q import open_issue_table
    return open_issue_table(spark, sf_dir)


@register("e3_page_status", """
SELECT view, CASE WHEN count(*) FILTER (WHERE trust = 'incomplete') > 0 THEN 'incomplete'
                  WHEN count(*) > 0 THEN 'flagged' ELSE 'verified' END AS status,
       count(*) AS issue_count, count(*) FILTER (WHERE trust = 'incomplete') AS incomplete_count,
       count(*) - count(*) FILTER (WHERE trust = 'incomplete') AS flagged_count
FROM page_issues_r GROUP BY view""", extra=EX)
def e3(spark, sf_dir):
    return evidence.validate_pages(issues(spark, sf_dir))


@register("e3_page_reasons", """
SELECT view, rank, rule_code, count, replace(lower(rule_code), '_', ' ') AS label FROM (
  SELECT view, rule_code, count(*) AS count,
         row_number() OVER (PARTITION BY view ORDER BY count(*) DESC, rule_code) AS rank
  FROM page_issues_r GROUP BY view, rule_code) WHERE rank <= 4""", extra=EX)
def e3r(spark, sf_dir):
    return evidence.page_reasons(issues(spark, sf_dir), 4)


EX["islands_r"] = """
SELECT l_returnflag, min(n) AS range_start, max(n) AS range_end FROM (
  SELECT l_returnflag, n, n - row_number() OVER (PARTITION BY l_returnflag ORDER BY n) AS g
  FROM (SELECT DISTINCT l_returnflag, l_orderkey AS n FROM lineitem))
GROUP BY l_returnflag, g"""


@register("w5_row_ranges", """
SELECT l_returnflag, range_start, range_end,
       CASE WHEN range_start = range_end THEN CAST(range_start AS VARCHAR)
            ELSE CAST(range_start AS VARCHAR) || ':' || CAST(range_end AS VARCHAR) END AS range_text
FROM islands_r""", extra=EX)
def w5(spark, sf_dir):
    return evidence.row_ranges(Tables(spark, sf_dir).lineitem, ["l_returnflag"], "l_orderkey")


EX["provenance_r"] = """
SELECT l_row AS source_row_id, 'lineitem.parquet' AS file_name,
       l_linestatus AS sheet_name, l_row AS row_number FROM lineitem_r"""


def provenance(L):
    li = L.t.lineitem
    sid = F.col("l_row")
    return li.select(sid.alias("source_row_id"), F.lit("lineitem.parquet").alias("file_name"),
                     F.col("l_linestatus").alias("sheet_name"), sid.alias("row_number"))


@register("e1_evidence_groups", """
SELECT file_name, sheet_name, count(DISTINCT row_number) AS rows, count(DISTINCT source_row_id) AS source_rows,
       min(row_number) AS first_row, max(row_number) AS last_row
FROM provenance_r WHERE source_row_id IN (SELECT actual_source_row_id FROM v6_r)
GROUP BY file_name, sheet_name""", extra=EX)
def e1(spark, sf_dir):
    L = StagedLedger(spark, sf_dir)
    v6 = marts.quality_deviation(L.quality_samples, L.sales_orders, L.lots)
    rows = provenance(L).join(v6.select(F.col("actual_source_row_id").alias("source_row_id")).distinct(),
                              "source_row_id", "left_semi")
    return evidence.evidence_groups(rows)


EX["env_ids_r"] = """SELECT DISTINCT CAST(actual_source_row_id AS BIGINT) AS source_row_id FROM (
  SELECT * FROM v6_r ORDER BY abs(deviation_fe_points) DESC, comparison, actual_source_row_id, expected_source_row_id,
           house_lot_number, expected_fe_pct, actual_fe_pct LIMIT 30)"""
EX["env_w_r"] = "SELECT * FROM issues_r WHERE source_row_id IN (SELECT source_row_id FROM env_ids_r)"


@register("e4_provenance_envelope", """
SELECT CASE WHEN (SELECT count(*) FROM provenance_r WHERE source_row_id IN (SELECT source_row_id FROM env_ids_r)) = 0 THEN 'incomplete'
            WHEN (SELECT count(*) FROM env_w_r) > 0 THEN 'flagged' ELSE 'verified' END AS status,
       CAST(30 AS BIGINT) AS row_count, (SELECT count(*) FROM env_ids_r) AS source_count,
       (SELECT count(DISTINCT (file_name, sheet_name)) FROM provenance_r
        WHERE source_row_id IN (SELECT source_row_id FROM env_ids_r)) AS source_groups,
       (SELECT count(DISTINCT rule_code) FROM env_w_r) AS warning_rules,
       (SELECT count(*) FROM env_w_r) AS warning_issues""", extra=EX)
def e4(spark, sf_dir):
    L = StagedLedger(spark, sf_dir)
    top = kpis.top_deviations(marts.quality_deviation(L.quality_samples, L.sales_orders, L.lots), 30)
    return evidence.provenance_envelope(top, "actual_source_row_id", provenance(L), issues(spark, sf_dir))


@register("e5_answer_log", """
SELECT conv_id, arg_max(role, turn) AS last_status, count(*) AS steps, count(DISTINCT role) AS distinct_statuses
FROM conversations GROUP BY conv_id""")
def e5(spark, sf_dir):
    return evidence.answer_log(Tables(spark, sf_dir).conversations)


_L = (r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(l0, '\*\*(.*?)\*\*', '\1', 'g'),"""
      r""" '`([^`]+)`', '\1', 'g'), '^#{1,6}\s+', ''), '^\s*[-*]\s+', '• ')""")
_MD_LINE = (r"""CASE WHEN regexp_full_match(""" + _L + r""", '^\s*\|(.+)\|\s*$') THEN array_to_string(list_transform("""
            r"""string_split_regex(regexp_extract(""" + _L + r""", '^\s*\|(.+)\|\s*$', 1), '\|'), lambda x: trim(x)),"""
            r""" ' — ') ELSE """ + _L + " END")
_MD = (r"""regexp_replace(regexp_replace(array_to_string(list_transform(list_filter(string_split(text, chr(10)),"""
       r""" lambda l: NOT regexp_full_match(l, '^\s*\|?[\s:|-]+\|?\s*$')), lambda l0: """ + _MD_LINE + r"""),"""
       r""" chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')""")


@register("f18_markdown_text", f"""
SELECT conv_id, turn, sha256(t) AS text_hash, CAST(length(t) AS BIGINT) AS text_length
FROM (SELECT conv_id, turn, {_MD} AS t FROM conversations)""")
def f18(spark, sf_dir):
    c = Tables(spark, sf_dir).conversations
    t = clean.markdown_to_text("text")
    return c.select("conv_id", "turn", F.sha2(t, 256).alias("text_hash"), F.length(t).cast("bigint").alias("text_length"))


EX["u2_r"] = """
SELECT file_name, sheet_name, row_number, file_name || '|' || sheet_name || '|' || CAST(row_number AS VARCHAR) AS source_key
FROM (SELECT DISTINCT file_name, sheet_name, row_number FROM (
        SELECT p.file_name, p.sheet_name, p.row_number FROM provenance_r p
        WHERE p.source_row_id IN (SELECT actual_source_row_id FROM v6_r)
        UNION ALL
        SELECT p.file_name, p.sheet_name, p.row_number FROM provenance_r p
        WHERE p.source_row_id IN (SELECT expected_source_row_id FROM v6_r WHERE comparison = 'inbound_vs_indicative')))"""


@register("u2_evidence_sources", "SELECT * FROM u2_r", extra=EX)
def u2(spark, sf_dir):
    L = StagedLedger(spark, sf_dir)
    v6 = marts.quality_deviation(L.quality_samples, L.sales_orders, L.lots)
    prov = provenance(L)
    a = prov.join(v6.select(F.col("actual_source_row_id").alias("source_row_id")), "source_row_id", "left_semi")
    b = prov.join(v6.where(F.col("comparison") == "inbound_vs_indicative")
                  .select(F.col("expected_source_row_id").alias("source_row_id")), "source_row_id", "left_semi")
    return evidence.union_sources(a, b)


@register("u2_top_sources", "SELECT * FROM u2_r ORDER BY file_name, sheet_name, row_number LIMIT 10", extra=EX)
def u2_top(spark, sf_dir):
    return evidence.top_sources(u2(spark, sf_dir))
