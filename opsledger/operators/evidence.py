"""Evidence, validation and answer logs.

Nothing here gathers an unbounded group into one row: evidence groups are counted, row
ranges are emitted as one row per range, and "top reasons" are ranked with a group limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checks import trust_class

CHUNK = 1 << 20

# --- fixed values: which page shows which domain ------------------------------------------
ALL_DOMAINS = ["inventory", "inward", "sales", "auctions", "quality", "production", "blend", "counterparties",
               "overview"]
VIEW_DOMAINS = {
    "overview": ALL_DOMAINS,
    "inventory": ["inventory"], "inward": ["inward"], "sales": ["sales"], "auctions": ["auctions"],
    "quality": ["quality"], "production": ["production"],
    "forecast": ["sales", "auctions", "quality", "production"], "blend": ["blend"],
    "counterparties": ["counterparties"], "calculations": ["inventory", "sales", "quality"],
    "trust": ALL_DOMAINS, "ask": ALL_DOMAINS,
}
# The domain of a source file by words of its name, and the domains of an issue by its entity.
FILE_WORDS = [("stock report", "inventory"), ("inward report", "inward"), ("outward report", "sales"), ("quality report", "quality"),
              ("auction", "auctions"), ("production report", "production"), ("planning", "blend"), ("transporter", "counterparties"),
              ("bulk permit", "counterparties")]
DOMAIN_ENTITIES = {
    "inventory": ["lot", "stock_snapshot", "inventory_movement", "lot_cost_component"],
    "inward": ["purchase_lot", "inward_receipt", "payment", "quality_sample"],
    "sales": ["sales_order_line", "dispatch", "permit"], "quality": ["quality_sample"], "production": ["production_run"],
    "blend": ["planning_stock"], "counterparties": ["organization", "transport_work_order"],
}
AUCTION_WORD, NO_DOMAIN = "auction", "overview"
# ---------------------------------------------------------------------------------------------


def issue_domains(entity: Column, key: Column) -> Column:
    """Domains an issue belongs to: every one that lists its entity; a source file's by the first words found in its name."""
    text = lambda v: F.lit(v).cast("string")
    listed = F.array_compact(F.array(*[F.when(entity.isin(names), text(d)) for d, names in DOMAIN_ENTITIES.items()],
                                     F.when(entity.contains(AUCTION_WORD), text("auctions"))))
    by_entity = F.when(F.size(listed) > 0, listed).otherwise(F.array(text(NO_DOMAIN)))
    name = F.lower(F.coalesce(key, F.lit("")))
    by_name = F.array_compact(F.array(*[F.when(name.contains(words), text(d)) for words, d in FILE_WORDS]))
    return F.when((entity == "source_file") & (F.size(by_name) > 0), F.slice(by_name, 1, 1)).otherwise(by_entity)


def _views_of(domains: Column) -> Column:
    """Pages that show any of the given domains (a literal map, no join)."""
    inv: dict[str, list[str]] = {}
    for view, ds in VIEW_DOMAINS.items():
        for d in ds:
            inv.setdefault(d, []).append(view)
    m = F.create_map(*[x for d, vs in inv.items() for x in (F.lit(d), F.array(*[F.lit(v) for v in vs]))])
    return F.array_distinct(F.flatten(F.transform(domains, lambda d: F.coalesce(m[d], F.array().cast("array<string>")))))


def page_issues(issues: DataFrame) -> DataFrame:
    """One row per (view, issue) for every page the issue is relevant to."""
    return issues.select("*", F.explode(_views_of(issue_domains(F.col("entity_name"), F.col("entity_key"))))
                         .alias("view"))


def validate_pages(issues: DataFrame) -> DataFrame:
    """Per page status and counts (incomplete if any incomplete-class issue, flagged if any issue)."""
    p = page_issues(issues).withColumn("trust", trust_class(F.col("rule_code"), F.col("severity")))
    return p.groupBy("view").agg(
        F.count(F.lit(1)).alias("issue_count"),
        F.count_if(F.col("trust") == "incomplete").alias("incomplete_count")).select(
        "view", F.when(F.col("incomplete_count") > 0, "incomplete").when(F.col("issue_count") > 0, "flagged")
        .otherwise("verified").alias("status"), "issue_count", "incomplete_count",
        (F.col("issue_count") - F.col("incomplete_count")).alias("flagged_count"))


def page_reasons(issues: DataFrame, k: int = 4) -> DataFrame:
    """The k most frequent rules per page (ties by rule code)."""
    per = page_issues(issues).groupBy("view", "rule_code").agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy("view").orderBy(F.col("count").desc(), "rule_code")
    return per.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        "view", "rank", "rule_code", "count", F.regexp_replace(F.lower("rule_code"), "_", " ").alias("label"))


def evidence_groups(rows: DataFrame) -> DataFrame:
    """Per (file, sheet) the number of distinct source rows and ids, and their extent."""
    return rows.groupBy("file_name", "sheet_name").agg(
        F.count_distinct("row_number").alias("rows"), F.count_distinct("source_row_id").alias("source_rows"),
        F.min("row_number").alias("first_row"), F.max("row_number").alias("last_row"))


def row_ranges(df: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Maximal runs of consecutive integers `n` per `keys`, one row per run
    (range_start, range_end, range_text 'a:b' or 'a').

    Gaps-and-islands (n - row_number) runs inside (keys, chunk of 2^20 values), so no group
    is larger than a chunk.  Runs that touch a chunk edge (at most two per chunk) are then
    merged with a second gaps-and-islands over those edge runs only."""
    d = df.select(*keys, F.col(n).cast("bigint").alias("n")).where(F.col("n").isNotNull()).distinct()
    d = d.withColumn("chunk", F.floor(F.col("n") / CHUNK))
    w = Window.partitionBy(*keys, "chunk").orderBy("n")
    runs = (d.withColumn("g", F.col("n") - F.row_number().over(w))
            .groupBy(*keys, "chunk", "g").agg(F.min("n").alias("s"), F.max("n").alias("e")))
    edge = (F.pmod(F.col("s"), F.lit(CHUNK)) == 0) | (F.pmod(F.col("e"), F.lit(CHUNK)) == CHUNK - 1)
    inner = runs.where(~edge).select(*keys, "s", "e")
    touching = runs.where(edge).select(*keys, "s", "e")
    w2 = Window.partitionBy(*keys).orderBy("s")
    t = (touching.withColumn("prev_e", F.lag("e").over(w2))
         .withColumn("new", F.when(F.col("prev_e").isNull() | (F.col("s") != F.col("prev_e") + 1), 1).otherwise(0))
         .withColumn("grp", F.sum("new").over(w2.rowsBetween(Window.unboundedPreceding, 0))))
    merged = t.groupBy(*keys, "grp").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("grp")
    out = inner.unionByName(merged)
    return out.select(*keys, F.col("s").alias("range_start"), F.col("e").alias("range_end"),
                      F.when(F.col("s") == F.col("e"), F.col("s").cast("string"))
                      .otherwise(F.concat_ws(":", F.col("s").cast("string"), F.col("e").cast("string")))
                      .alias("range_text"))


def provenance_envelope(result: DataFrame, id_col: str, provenance: DataFrame, issues: DataFrame,
                        max_rows: int = 100) -> DataFrame:
    """Trust envelope of a result: rows, all distinct source ids, provenance groups and open issues
    on those rows; status verified / flagged / incomplete (no provenance, or more rows than a reader is shown)."""
    ids = result.select(F.col(id_col).cast("bigint").alias("source_row_id")).where(
        F.col("source_row_id").isNotNull()).distinct()
    n_rows = result.agg(F.count(F.lit(1))).scalar()
    n_ids = ids.agg(F.count(F.lit(1))).scalar()
    prov = provenance.join(ids, "source_row_id", "left_semi")
    groups = prov.agg(F.count_distinct("file_name", "sheet_name").alias("g")).select("g").scalar()
    # the issue table is aggregated once; the other parts are cheap one-row scalars
    stats = issues.join(ids, "source_row_id", "left_semi").agg(
        F.count_distinct("rule_code").alias("warning_rules"), F.count(F.lit(1)).alias("warning_issues"))
    status = (F.when((n_rows == 0) | (n_rows > max_rows) | (groups == 0), "incomplete")
              .when(F.col("warning_issues") > 0, "flagged").otherwise("verified"))
    return stats.select(status.alias("status"), n_rows.alias("row_count"), n_ids.alias("source_count"),
                        groups.alias("source_groups"), "warning_rules", "warning_issues")


def answer_log(log: DataFrame, conv: str = "conv_id", turn: str = "turn", status: str = "role") -> DataFrame:
    """E5 / L3: per conversation the status of the last step and the number of steps."""
    return log.groupBy(conv).agg(F.max_by(status, turn).alias("last_status"), F.count(F.lit(1)).alias("steps"),
                                 F.count_distinct(status).alias("distinct_statuses"))


def union_sources(*sources: DataFrame) -> DataFrame:
    """Keyed union of source lists (file, sheet, row): duplicates removed by key."""
    out = sources[0].select("file_name", "sheet_name", "row_number")
    for s in sources[1:]:
        out = out.unionByName(s.select("file_name", "sheet_name", "row_number"))
    return (out.dropDuplicates(["file_name", "sheet_name", "row_number"])
            .withColumn("source_key", F.concat_ws("|", "file_name", "sheet_name", F.col("row_number").cast("string"))))


def top_sources(sources: DataFrame, k: int = 10) -> DataFrame:
    """The first k keyed sources, as an answer lists them."""
    return sources.orderBy("file_name", "sheet_name", "row_number").limit(k)
