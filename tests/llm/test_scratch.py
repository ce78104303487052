"""What the operators of this subpackage write, move and keep, and the kernels that were rewritten for it."""

import os
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from opsledger.llm import chosen_path, kernel, line_dedup, links, suffix_family
from opsledger.llm.common import marked, marks, scratch_dir, written

SHAPE = "doc_id long, text string"


def tables(spark):
    folder = scratch_dir(spark).removeprefix("file:")
    return {n for n in os.listdir(folder) if n.startswith("llm-")} if os.path.isdir(folder) else set()


def lines_of(seed, n):
    rng = random.Random(seed)
    return [" ".join(rng.choice("abcdefghij") * rng.randrange(1, 9) for _ in range(30)) for _ in range(n)]


def test_marks_miss_no_id(spark):
    ids = [0, 1, -1, 32767, 32768, 2**62, -2**63, 12345678901234567]
    bits = marks(spark.createDataFrame([(i,) for i in ids], "id long")).value
    assert marked(bits, np.array(ids, np.int64).view(np.uint64)).all()
    others = np.random.default_rng(1).integers(0, 2**63, 10000).astype(np.uint64)
    assert marked(bits, others).mean() < 0.01
    assert not marked(marks(spark.createDataFrame([], "id long")).value, others).any()


def test_only_wanted_lines_are_shuffled(spark):
    lines = lines_of(1, 200)
    docs = spark.createDataFrame([(i, "\n".join(lines[10 * i:10 * i + 10])) for i in range(20)], SHAPE)
    table = line_dedup.line_table(docs, "doc_id", "text")
    ids = written(table.where("doc_id = 3").select("id"), "ids")
    got = line_dedup.line_texts(docs, "doc_id", "text", ids)
    assert sorted(bytes(r.text).decode() for r in got.collect()) == sorted(set(lines[30:40]))
    wanted = marks(ids).value
    sent = line_dedup._wanted_lines(kernel.Texts.of(pa.array(lines)), lambda x: marked(wanted, x))[0]
    assert 10 <= len(sent) < 20


def test_tables_that_nothing_reads_are_deleted(spark):
    lines = lines_of(2, 40)
    near = [x[:-1] + "z" for x in lines[:10]] + [lines[0][:-2] + c for c in ("zx", "zy", "zv")]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines + near)], SHAPE)
    before = tables(spark)
    out = line_dedup.decisions(docs)
    left = {n.split("-")[1] for n in tables(spark) - before}
    assert not left & {"ends", "members", "texts", "ids", "pairs", "first", "rooted", "best"}
    assert out.count() == 53
    assert out.where(~F.col("kept")).count() >= 10


def test_common_counts_match_sets():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 300):
        oa, ob = rng.integers(0, n, 900), rng.integers(0, n, 700)
        pool = kernel.seeds(40, 9)
        ha, hb = rng.choice(pool, 900), rng.choice(pool, 700)
        got = links.common_counts(oa, ha, ob, hb, n)
        for k in range(n):
            a, b = set(ha[oa == k]), set(hb[ob == k])
            assert tuple(x[k] for x in got) == (len(a), len(b), len(a & b))
    assert [len(x) for x in links.common_counts(oa[:0], ha[:0], ob[:0], hb[:0], 4)] == [4] * 3


def test_bands_do_not_depend_on_the_block(monkeypatch):
    values = lines_of(5, 30) + ["", "short", "x" * 900, "abcdefgh", "é\tü"] + [" ".join(lines_of(6, 4))]
    t = kernel.Texts.of(pa.array(values))

    def keys():
        own, key = line_dedup.band_keys(t)
        return sorted(zip(own.tolist(), key.tolist()))

    whole = keys()
    monkeypatch.setattr(line_dedup, "_BLOCK", 100)
    assert keys() == whole
    own, h = line_dedup.char_shingles(t)
    assert np.bincount(own, minlength=t.n).tolist() == [max(len(v.encode()) - 7, len(v) > 0) for v in values]


def test_runs_do_not_depend_on_the_block(monkeypatch):
    t = kernel.Texts.of(pa.array([None, "short", *lines_of(8, 12), "x" * 700, "y" * 49, "z" * 50]))
    whole = suffix_family.Runs(t)
    monkeypatch.setattr(suffix_family, "BLOCK", 60)
    parted = suffix_family.Runs(t)
    assert len(whole.first) > 100
    for name in ("first", "last", "anchor", "doc", "head"):
        assert getattr(parted, name).tolist() == getattr(whole, name).tolist()


def test_suffix_family_keeps_the_last_table_only(spark):
    lines = lines_of(9, 6)
    docs = spark.createDataFrame([(i, lines[i % 6] + lines[(i + 1) % 6]) for i in range(12)], SHAPE)
    before = tables(spark)
    out = suffix_family.removal(docs)
    assert {n.split("-")[1] for n in tables(spark) - before} == {"spans"}
    assert out.where("n_removed > 0").count() >= 6


def test_a_row_of_a_block_may_be_compared_and_compared_with():
    text = lines_of(11, 2)
    block = pa.table({"odd": [False, True, True, True], "other": [True, True, True, False], "id": [1, 2, 3, 4], "root": [1, 2, 3, 4],
                      "text": pa.array([text[0].encode(), (text[1] + "z").encode(), text[1].encode(), text[0].encode()], pa.binary())})
    got = links.compare_block(block, line_dedup.char_shingles, 75)
    assert sorted(set(zip(got["a"].to_pylist(), got["b"].to_pylist()))) == [(1, 4), (2, 3)]


def test_near_duplicates_send_candidates_only_and_delete_tables(spark):
    lines = lines_of(12, 30)
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)] + [(100, lines[0] + " z"), (101, lines[1]), (None, lines[2])], SHAPE)
    ids = written(spark.createDataFrame([(0,), (100,)], "id long"), "ids")
    assert sorted(r.id for r in chosen_path.texts_of(docs, "doc_id", "text", ids).collect()) == [0, 100]
    before = tables(spark)
    out = chosen_path.near_duplicates(docs)
    left = {n.split("-")[1] for n in tables(spark) - before}
    assert not left & {"reps", "ids", "texts", "likely"}
    assert {r.doc_id for r in out.where(~F.col("kept")).collect()} >= {101}
