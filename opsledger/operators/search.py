"""Evidence search: document build (D1), retrieval (D2), context text (D3).

Scoring (per question q and document d):
    sum over distinct tokens t of q:  3 if area(d) contains t, + 1 if text(d) contains t
  + 5 if the whole lower-cased question (longer than 4 characters) occurs in "area text"
Hits need score > 0; each question keeps its top k by (score desc, id); a question with
no hit falls back to the first two documents.

Containment is substring containment over whole texts, so it cannot be an equi-join on
words.  Instead the distinct dictionary of all question tokens and phrases is compiled
into one Aho-Corasick automaton, shipped to the executors, and every document is scanned
once (mapInPandas, Arrow batches).  The scan emits (doc, key, in_area, in_text) for the
keys that occur; these are equi-joined back to the (question, key) pairs and summed.
The dictionary is broadcast only while it is below `max_dictionary_bytes`; a larger one is
split into chunks that are scanned in turn (same result, more passes).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clean

MATCH_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("key", T.StringType()),
    T.StructField("in_area", T.BooleanType()), T.StructField("in_text", T.BooleanType()),
    T.StructField("in_haystack", T.BooleanType())])


def build_documents(*parts: DataFrame) -> DataFrame:
    """Union of (doc_id, area, text, source) relations."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def question_keys(questions: DataFrame) -> DataFrame:
    """(item_id, key, kind): distinct search tokens (F19) and the whole phrase (if > 4 chars)."""
    tok = questions.select("item_id", F.explode(clean.search_tokens("text")).alias("key"),
                           F.lit("token").alias("kind"))
    phrase = questions.select("item_id", F.regexp_replace(F.lower("text"), r"^\s+|\s+$", "").alias("key"),
                              F.lit("phrase").alias("kind")) \
        .where(F.length("key") > 4)
    return tok.unionByName(phrase)


def _scanner(keys: list[str]):
    """Per-partition scan: emit each dictionary key found in area, text or 'area text'.

    Token keys are [a-z0-9]+, so a token occurs in a text exactly when it occurs inside one
    of the text's maximal [a-z0-9]+ runs; the token automaton therefore scans each distinct
    word of a document once.  Phrase keys (whole questions) are scanned over 'area text'."""
    import re
    word_re = re.compile(r"[a-z0-9]+")
    tokens = [k for k in keys if word_re.fullmatch(k)]
    phrases = [k for k in keys if not word_re.fullmatch(k)]

    def scan(batches):
        import pandas as pd
        try:
            import ahocorasick
        except ImportError:  # pragma: no cover - plain fallback
            ahocorasick = None

        def matcher(words):
            if not words:
                return lambda s: set()
            if ahocorasick is not None:
                auto = ahocorasick.Automaton()
                for k in words:
                    auto.add_word(k, k)
                auto.make_automaton()
                return lambda s: {v for _, v in auto.iter(s)} if s else set()
            return lambda s: {k for k in words if k in s}

        find_tokens, find_phrases = matcher(tokens), matcher(phrases)
        for pdf in batches:
            out = {"doc_id": [], "key": [], "in_area": [], "in_text": [], "in_haystack": []}
            for doc_id, area, text in zip(pdf["doc_id"], pdf["area"], pdf["text"]):
                area = (area or "").lower()
                text = (text or "").lower()
                a = find_tokens("\x00".join(set(word_re.findall(area))))
                t = find_tokens("\x00".join(set(word_re.findall(text))))
                h = find_phrases(area + " " + text)
                for k in a | t:
                    out["doc_id"].append(int(doc_id))
                    out["key"].append(k)
                    out["in_area"].append(k in a)
                    out["in_text"].append(k in t)
                    out["in_haystack"].append(True)
                for k in h:
                    out["doc_id"].append(int(doc_id))
                    out["key"].append(k)
                    out["in_area"].append(False)
                    out["in_text"].append(False)
                    out["in_haystack"].append(True)
            yield pd.DataFrame(out, columns=list(out))
    return scan


MAX_KEYS = 2_000_000


def key_matches(documents: DataFrame, keys: DataFrame, max_dictionary_bytes: int = 64 << 20,
                chunk_keys: int = 200_000) -> DataFrame:
    """(doc_id, key, in_area, in_text, in_haystack) for every dictionary key occurring in a document.

    The distinct keys are fetched with a bounded `limit` (at most MAX_KEYS + 1 rows) and the
    automaton is shipped only when the dictionary is under `max_dictionary_bytes`; a larger one
    is scanned in chunks of `chunk_keys` keys (more passes over the documents, same result)."""
    dictionary = keys.select("key").distinct()
    docs = documents.select("doc_id", "area", "text")
    # A few large files can arrive as fewer splits than there are cores; spread them once
    # (on a cluster with many input splits this is a no-op).
    parallelism = docs.sparkSession.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < parallelism:
        docs = docs.repartition(parallelism)
    head = [r["key"] for r in dictionary.limit(MAX_KEYS + 1).collect()]
    if not head:
        return docs.sparkSession.createDataFrame([], MATCH_SCHEMA)
    if len(head) <= MAX_KEYS and sum(len(k) for k in head) * 4 <= max_dictionary_bytes:
        return docs.mapInPandas(_scanner(head), MATCH_SCHEMA)
    n = dictionary.count()
    numbered = dictionary.withColumn("chunk", F.pmod(F.xxhash64("key"), F.lit(max(1, (n + chunk_keys - 1) // chunk_keys))))
    out = None
    for c in [r["chunk"] for r in numbered.select("chunk").distinct().collect()]:
        words = [r["key"] for r in numbered.where(F.col("chunk") == c).select("key").collect()]
        part = docs.mapInPandas(_scanner(words), MATCH_SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def retrieve(questions: DataFrame, documents: DataFrame, k: int = 14) -> DataFrame:
    """Top-k documents per question (item_id, rank, doc_id, area, score)."""
    qk = question_keys(questions)
    m = key_matches(documents, qk).select(
        "doc_id", "key",
        (F.when(F.col("in_area"), 3).otherwise(0) + F.when(F.col("in_text"), 1).otherwise(0)).alias("token_pts"),
        F.when(F.col("in_haystack"), 5).otherwise(0).alias("phrase_pts"))
    j = qk.join(m, "key", "inner")
    pts = F.when(F.col("kind") == "token", F.col("token_pts")).otherwise(F.col("phrase_pts"))
    scored = j.groupBy("item_id", "doc_id").agg(F.sum(pts).alias("score")).where(F.col("score") > 0)
    w = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id"))
    ranked = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    # Fallback: questions without hits get the first two documents (score 0).
    # (two ids: a bounded take, turned into literals)
    first2 = [r["doc_id"] for r in documents.select("doc_id").orderBy("doc_id").limit(2).collect()]
    pairs = F.array(*[F.struct(F.lit(i + 1).alias("rank"), F.lit(d).cast("bigint").alias("doc_id"))
                      for i, d in enumerate(first2)]) if first2 else F.array().cast(
        "array<struct<rank:int,doc_id:bigint>>")
    fallback = questions.select("item_id", F.explode(pairs).alias("p")).select(
        "item_id", F.col("p.rank").alias("rank"), F.col("p.doc_id").alias("doc_id"),
        F.lit(0).cast("bigint").alias("score"))
    # A question's few hits meet its fallback here; asking for the questions without hits would scan all documents again.
    hits = ranked.select("item_id", "rank", "doc_id", F.col("score").cast("bigint").alias("score"))
    both = hits.withColumn("hit", F.lit(True)).unionByName(fallback.withColumn("hit", F.lit(False)))
    found = F.max("hit").over(Window.partitionBy("item_id")) & F.col("item_id").isNotNull()
    out = both.withColumn("found", found).where(F.col("hit") | ~F.col("found")).drop("hit", "found")
    return out.join(documents.select("doc_id", "area"), "doc_id").select("item_id", "rank", "doc_id", "area", "score")


def context_text(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """D3: per question, '[i] area\\nSource: ...\\nData: text' blocks of the ranked hits.

    Hits per question are at most k, so the collect is bounded by k."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("area"), F.lit("\nSource: "),
                     F.col("source"), F.lit("\nData: "), F.col("text"))
    j = hits.join(documents.select("doc_id", "source", "text"), "doc_id")
    return j.groupBy("item_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("context"))
