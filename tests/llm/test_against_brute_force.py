"""Lines, languages and the pipeline against plain Python over whole small tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from opsledger.llm import byte_bpe, chosen_path, line_dedup, links, quality_rules
from opsledger.llm.common import table
from opsledger.llm.queries import VOCABULARY, op5_language_mixture, pattern

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]")


def shingles(line: bytes) -> frozenset:
    line = line.lower() if line.isascii() else bytes(c + 32 if 65 <= c <= 90 else c for c in line)
    n = line_dedup.SHINGLE
    return frozenset(line[i:i + n] for i in range(len(line) - n + 1)) or frozenset([line])


@pytest.fixture(scope="module")
def lines(spark):
    """Documents with equal, near and unlike lines, short ones and long ones, in random order."""
    rng = random.Random(31)
    letters = "abcdefghij klmnop"
    base = ["".join(rng.choices(letters, k=rng.choice([12, 60, 200, 900]))) for _ in range(40)] + ["NaN, " * 22, "Read more", "--------"]
    rows = []
    for i in range(90):
        picked = []
        for x in rng.choices(base, k=rng.randint(1, 4)):
            y = list(x)
            for _ in range(rng.choice([0, 0, 1, 3, 20])):
                y[rng.randrange(len(y))] = rng.choice(letters)
            picked.append("".join(y))
        rows.append((i, "\n".join(picked)))
    rng.shuffle(rows)
    return rows


def test_lines_match_brute_force(spark, lines):
    got = {(r.doc_id, r.line_no): (r.keeper_doc_id, r.keeper_line_no, r.kept) for r in line_dedup.decisions(
        spark.createDataFrame(lines, "doc_id long, text string").repartition(4)).collect()}
    at = [((d, n), x.encode()) for d, t in lines for n, x in enumerate(t.split("\n")) if WORD.search(x.encode())]
    sets = {k: shingles(x) for k, x in at}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    keys, strong, alike = sorted(sets), 0, []
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            x, y = sets[a], sets[b]
            if 100 * len(x & y) >= line_dedup.PERCENT * len(x | y):
                strong += 1
                alike += [(a, b)] * (100 * len(x & y) >= 90 * len(x | y))
                p, q = sorted((find(a), find(b)))
                root[q] = p
    want = {k: (*find(k), find(k) == k) for k in keys}
    assert strong > 100 and any(not w[2] for w in want.values()) and any(w[2] for w in want.values())
    # no link is made up, links of 0.9 and more are all found, and bands miss few of the others (1 % at 0.75)
    assert set(got) == set(want)
    keeper = {k: (g[0], g[1]) for k, g in got.items()}
    assert all(want[k][:2] == want[keeper[k]][:2] and got[k][2] == (keeper[k] == k) and keeper[k] <= k for k in got)
    assert all(keeper[a] == keeper[b] for a, b in alike)
    assert sum(got[k] != want[k] for k in want) <= 0.02 * len(want)


def test_languages_of_documents_that_were_not_learned_from(spark):
    rows = op5_language_mixture(spark, SF).collect()
    truth = {r.doc_id: r.lang for r in table(spark, SF, "documents").select("doc_id", "lang").collect()}
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out and truth[r.doc_id] is not None and r.lang_pred != "und"]
    assert len(held) > 40 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_rows_without_an_id_have_a_fold(spark, tmp_path):
    docs = table(spark, SF, "documents")
    odd = spark.createDataFrame([(None, "Where is the house", "en"), (None, None, None), (-1, "", None), (-2, "123 --", "de")], "doc_id long, text string, lang string")
    docs.select("doc_id", "text", "lang").unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    rows = op5_language_mixture(spark, str(tmp_path)).collect()
    assert len(rows) == docs.count() + 4 and all(r.held_out is not None and r.lang_pred is not None for r in rows)
    assert [r.held_out for r in rows if r.doc_id is None] == [False, False]
    assert {r.lang_pred for r in rows if r.doc_id is not None and r.doc_id < 0} == {"und"}


def test_stages_follow_from_one_another(spark):
    """Each stage of the pipeline, by its own definition, on what the stage before it left."""
    import tiktoken

    docs = table(spark, SF, "documents")
    by_id = lambda df: {r.doc_id: r for r in df.collect()}
    columns, steps = docs.columns, [by_id(docs)]
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF).cache()
        assert now.columns == columns
        steps.append(by_id(now))
    first, good, lined, unlike, clean = steps
    verdict = {r.doc_id: r.kept for r in quality_rules.quality_columns(docs, ["doc_id"]).collect()}
    assert set(good) == {i for i in first if verdict[i]} and all(good[i].text == first[i].text for i in good)
    for i, r in lined.items():
        rest = iter((good[i].text or "").split("\n"))
        assert all(any(x == y for y in rest) for x in (r.text or "").split("\n")), "lines are only taken out, in order"
    seen = {}
    for i in sorted(lined):  # no two documents keep the same line
        for x in set((lined[i].text or "").split("\n")):
            if WORD.search(x.encode()):
                assert seen.setdefault(x, i) == i
    kept = {r.doc_id for r in chosen_path.near_duplicates(spark.createDataFrame(
        [(i, lined[i].text) for i in lined], "doc_id long, text string")).where("kept").collect()}
    assert set(unlike) == kept and set(clean) <= kept
    whole = [(i, " ".join(r.text.split())) for i, r in by_id(table(spark, SF, "benchmark").withColumnRenamed("item_id", "doc_id")).items()]
    for i in clean:  # nothing that is left holds a whole item of some length
        text = " ".join((clean[i].text or "").split())
        assert not any(len(q) > 60 and q in text for _, q in whole)
    ranks = {t: n for n, t in enumerate(byte_bpe.read_ranks(byte_bpe.vocabulary(VOCABULARY)))}
    tok = tiktoken.Encoding("own", pat_str=pattern(), mergeable_ranks=ranks, special_tokens={})
    out = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
    assert {r.doc_id for r in out} == set(clean)
    for r in out:
        ids = tok.encode_ordinary(clean[r.doc_id].text or "")
        assert bytes(r.ids) == b"".join(n.to_bytes(4, "little") for n in ids) and bytes(r.decoded) == (clean[r.doc_id].text or "").encode()


def test_pipeline_on_empty_documents(spark, tmp_path):
    docs = table(spark, SF, "documents")
    docs.where("false").write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, SF, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    odd = docs.limit(3).withColumn("text", F.lit(None).cast("string")).unionByName(docs.limit(2).withColumn("text", F.lit("")))
    odd.write.parquet(f"{tmp_path}/odd/documents.parquet")
    table(spark, SF, "benchmark").write.parquet(f"{tmp_path}/odd/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/odd").count() == 0  # a document without words is rejected


@pytest.mark.parametrize("limits", [(4, 3, 1 << 20, 1 << 20), (4096, 2048, 300, 200), (4096, 2048, 4 << 20, 2 << 20)])
def test_blocks_of_a_group_hold_every_link(spark, monkeypatch, limits):
    """Whether blocks end by rows, by bytes or not at all, a group's links are those of brute force."""
    for name, value in zip(("BLOCK", "AGAINST", "BLOCK_BYTES", "AGAINST_BYTES"), limits):
        monkeypatch.setattr(links, name, value)
    rng = random.Random(5)
    base = ["".join(rng.choices("abcdefg hij", k=60)) for _ in range(6)] + ["x" * 3000]
    texts = []
    for i in range(45):
        y = list(rng.choice(base))
        y[rng.randrange(6)] = rng.choice("klmn")
        texts.append((i, "".join(y).encode()))
    texts.append((45, b""))
    members = spark.createDataFrame([(7, i, i, 0) for i, _ in texts], "key long, id long, root long, least long")
    got = links.block_links(members, spark.createDataFrame(texts, "id long, text binary"), line_dedup.char_shingles, 75, "blocks")
    sets = {i: shingles(t) for i, t in texts if t}
    want = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert {(r.a, r.b) for r in got.collect()} == want and len(want) > 50
