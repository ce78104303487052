"""Secret scan with a random forest for false-positive removal (operator 6; DataFrame functions and MLlib only).

Candidates are values assigned to the name of a credential, whatever their characters, and long runs of key characters
with a digit.  Splitting a text at its candidates gives the text between them, hence each candidate's neighbouring words, in one linear pass.  Features: length, character classes and
transitions, dictionary coverage, the path (source) and the neighbouring words.  The forest learns from labelled
findings and scores every candidate.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SIDE = 48  # characters kept on either side of a candidate
TRAINING_ROWS = 20_000  # bound of the labelled sample (distinct features) the forest is fitted on, half of it for each label
TREES, TREE_DEPTH, SEED = 24, 6, 42
THRESHOLD = 0.5

# Names of credentials, names of harmless identifiers, and common words inside identifiers.
CREDENTIAL = "token|secret|passwd|password|pwd|apikey|api_key|api-key|access_key|auth|credential|private_key|bearer"
HARMLESS = "sha1|sha256|md5|commit|checksum|digest|uuid|guid|hash|etag|revision|build|version|phone|card|order|invoice"
# A value beside NAME= or NAME: is in quotes, or runs to the next space or quote; the tests of single characters before
# it come first, for speed.  A run of key characters does not begin with such a name, so the value is left to ASSIGNED.
_GIVEN = rf"(?<=(?i:{CREDENTIAL})[\"'`]?[ \t]{{0,8}}[=:]{{1,2}}>?[ \t]{{0,8}}[\"'`]?)"
ASSIGNED = (r"(?<=[\"'`=:> \t])(?=[^\s\"'`])(?<=[=:]>?[ \t]{0,8}[\"'`]?)" + _GIVEN + r"(?![=:>])"
            r"(?:(?<=\")[^\"\r\n]+(?=\")|(?<=')[^'\r\n]+(?=')|(?<=`)[^`\r\n]+(?=`)|[^\s\"'`]*[^\s\"'`,;.)}\]>])")
RUN = (r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])" rf"(?![A-Za-z0-9+/_-]*(?i:{CREDENTIAL})={{1,2}}[^\s\"'`=])"
       r"[A-Za-z0-9+/_=-]{12,}")
CANDIDATE = f"{ASSIGNED}|{RUN}"
DICTIONARY = ("example sample test demo dummy default user name value key data file path http https www com org net html index "
              "image static content page item list table field query number string object class function module version config "
              "server client local public private system service account the and for with that this from have").split()

FEATURES = ["f_length", "f_digits", "f_upper", "f_lower", "f_other", "f_transitions", "f_distinct", "f_hex", "f_dictionary",
            "f_path_depth", "f_path_digits", "f_path_test", "f_credential", "f_harmless", "f_assigned", "f_quoted", "f_left_words", "f_right_words"]


def findings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """(doc_id, nth, candidate, before, after, path): every candidate with up to SIDE characters on either side."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(path).cast("string").alias("path"), F.col(text).alias("__text"))
    d = d.select("doc_id", "path", F.regexp_extract_all("__text", F.lit(CANDIDATE), F.lit(0)).alias("found"), "__text").where(F.size("found") > 0)
    d = d.withColumn("gaps", F.split("__text", CANDIDATE, -1))
    one = F.transform("found", lambda c, i: F.struct(c.alias("candidate"), F.right(F.get("gaps", i), F.lit(SIDE)).alias("before"),
                                                     F.left(F.get("gaps", i + 1), F.lit(SIDE)).alias("after")))
    return d.select("doc_id", "path", F.posexplode(one).alias("nth", "f")).select("doc_id", F.col("nth").cast("long").alias("nth"), "f.*", "path")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def features(found: DataFrame) -> DataFrame:
    """`found` with its FEATURES (doubles, never null)."""
    c, before, after = F.col("candidate"), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit(""))
    path = F.coalesce("path", F.lit(""))
    n = F.length(c).cast("double")
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]", "a"), "[A-Z]", "b"), "[0-9]", "c"), "[^abc]", "d")
    known = "(" + "|".join(sorted(DICTIONARY, key=len, reverse=True)) + ")"
    left = F.lower(before)
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    return found.withColumns({
        "f_length": n,
        "f_digits": _count(c, "[0-9]") / n,
        "f_upper": _count(c, "[A-Z]") / n,
        "f_lower": _count(c, "[a-z]") / n,
        "f_other": _count(c, "[^A-Za-z0-9]") / n,
        "f_transitions": (F.length(F.regexp_replace(classes, r"(.)\1*", "$1")) - 1).cast("double") / n,
        "f_distinct": F.size(F.array_distinct(F.split(c, ""))).cast("double") / n,
        "f_hex": flag(F.rlike(c, F.lit("^[0-9a-f]+$"))),
        "f_dictionary": 1 - F.length(F.regexp_replace(F.lower(c), known, "")).cast("double") / n,
        "f_path_depth": _count(path, "[/.]"),
        "f_path_digits": _count(path, "[0-9]"),
        "f_path_test": flag(F.rlike(F.lower(path), F.lit("test|example|sample|mock"))),
        "f_credential": flag(F.rlike(left, F.lit(rf"({CREDENTIAL})\W{{0,6}}$"))),
        "f_harmless": flag(F.rlike(left, F.lit(rf"({HARMLESS})\W{{0,6}}$"))),
        "f_assigned": flag(F.rlike(before, F.lit(r"[=:]\s*[\"']?$"))),
        "f_quoted": flag(F.rlike(before, F.lit("[\"'`]$")) & F.rlike(after, F.lit("^[\"'`]"))),
        "f_left_words": _count(before, r"\p{L}{3,}"),
        "f_right_words": _count(after, r"\p{L}{3,}"),
    })


def evidence(found: DataFrame) -> Column:
    """Label of findings that their own text settles: 1.0 for a quoted value assigned to the name of a credential, 0.0
    for digits only, a value after the name of a harmless identifier, or dictionary text; null for all others."""
    left = F.lower(F.coalesce("before", F.lit("")))
    return (F.when(F.rlike(left, F.lit(rf"({CREDENTIAL})[\"']?\s*[=:]\s*[\"']$")) & (F.length("candidate") >= 16), 1.0)
            .when(F.rlike("candidate", F.lit("^[0-9]+$")) | F.rlike(left, F.lit(rf"({HARMLESS})\W{{0,6}}$")), 0.0))


def scored(found: DataFrame, labelled: DataFrame) -> DataFrame:
    """`found` (with FEATURES) plus probability and is_secret, by a forest fitted on `labelled` (FEATURES and label).

    The forest sees at most TRAINING_ROWS distinct rows, weighted by their number: of each label half as many, those first
    by the hash of their features, so equal tables give equal forests.  With labels of one class only, that class is the
    answer; without labels nothing is a secret."""
    order = F.xxhash64(*FEATURES, "label")
    distinct = written(labelled.groupBy(*FEATURES, "label").agg(F.count(F.lit(1)).cast("double").alias("weight")), "distinct")
    half = lambda label: distinct.where(F.col("label") == label).orderBy(order).limit(TRAINING_ROWS // 2)
    sample = written(half(0.0).union(half(1.0)), "labels")
    seen = sample.agg(F.min("label").alias("lo"), F.max("label").alias("hi")).first()
    if seen["lo"] == seen["hi"]:
        flat = found.withColumn("probability", F.lit(float(seen["hi"] or 0.0)))
    else:
        stages = [VectorAssembler(inputCols=FEATURES, outputCol="__v"),
                  RandomForestClassifier(featuresCol="__v", labelCol="label", weightCol="weight", numTrees=TREES, maxDepth=TREE_DEPTH, seed=SEED,
                                         probabilityCol="__p", rawPredictionCol="__r", predictionCol="__c", maxMemoryInMB=64)]
        flat = Pipeline(stages=stages).fit(sample).transform(found)
        flat = flat.withColumn("probability", F.get(vector_to_array("__p"), F.lit(1))).drop("__v", "__p", "__r", "__c")
    return flat.withColumn("is_secret", F.col("probability") >= THRESHOLD)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = "source", labelled: DataFrame | None = None) -> DataFrame:
    """Every candidate of `docs`: doc_id, nth (its number in the text), candidate, path, probability, is_secret.

    `labelled` are findings with FEATURES and a label (1.0 secret, 0.0 not); by default those that `evidence` settles.
    Null and empty texts have no candidates; a null path counts as empty; repeated rows repeat; an empty table gives no
    rows; other columns are ignored."""
    found = written(features(findings(docs, doc_id, text, path)), "findings")
    if labelled is None:
        labelled = found.withColumn("label", evidence(found)).where("label is not null")
    return scored(found, labelled).select("doc_id", "nth", "candidate", "path", "probability", "is_secret")
