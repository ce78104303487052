"""Operators 11 to 13 against numpy, the tokenizers library and exhaustive search; nulls, ties, copies, empty tables."""

import functools
import hashlib
import json
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from opsledger.llm import conversation_repair as repair
from opsledger.llm import whitening, word_bpe
from opsledger.llm.lexicon import Transducer, compile_lexicon

VOCAB = "word_bpe_49k.json"


# whitening

def whitened(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, key string, x int, n int, component int, h long")
    return whitening.whiten(df, **more).collect()


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(120, 6)) @ rng.normal(size=(6, 6)) * 0.3
    return [*base.astype(np.float32).tolist(), *base[:40].astype(np.float32).tolist(), *[base[3].astype(np.float32).tolist()] * 60]


def test_whitening_matches_numpy(spark, vectors, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 16)
    odd = [None, [], [1.0, None, 1.0, 1.0, 1.0, 1.0], [float("nan")] * 6, [float("inf")] * 6, [1.0, 2.0]]
    rows = [(i, v, "k", 1, 2, 3, 4) for i, v in enumerate([*vectors, *odd])] + [(None, vectors[0], "k", 1, 2, 3, 4)]
    got = whitened(spark, rows)
    x = np.floor(256 * np.array(vectors, np.float64)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    v = np.cov(fit.T, bias=True)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:4], u[:, ::-1][:, :4]
    want = (x - s / n) @ u / np.sqrt(e)
    by = {(r.vec_id, r.component): r for r in got if r.vec_id is not None}
    assert len(got) == 4 * (len(vectors) + 1) and len(by) == 4 * len(vectors)
    for c in range(4):
        mine = np.array([by[i, c + 1].whitened for i in range(len(vectors))])
        assert min(abs(mine - want[:, c]).max(), abs(mine + want[:, c]).max()) < 1e-9
        assert abs(by[0, c + 1].explained - e[c] / np.trace(v)) < 1e-9
    for i, row in enumerate(x):
        assert by[i, 1].deviation == int(((n * row - s) ** 2).sum()) and by[i, 1].n == n
    assert {r.identity_error for r in got}.pop() < 1e-9 and len({r.identity_error for r in got}) == 1


def test_whitening_without_variance(spark):
    one = whitened(spark, [(1, [1.0, 2.0], "", 0, 0, 0, 0), (2, [1.0, 2.0], "", 0, 0, 0, 0)])
    assert len(one) == 4 and all(r.whitened is None and r.deviation == 0 and r.explained is None for r in one)
    line = whitened(spark, [(i, [float(i), 2.0 * i], "", 0, 0, 0, 0) for i in range(5)])
    assert [r.whitened is None for r in sorted(line, key=lambda r: (r.vec_id, r.component))] == [False, True] * 5
    assert whitened(spark, []) == [] and whitened(spark, [(1, None, "", 0, 0, 0, 0)]) == []


def test_deviation_beyond_a_long_is_null():
    raw = np.array([[1 << 40, 0], [0, 0]], np.int64).tobytes()
    assert whitening.deviations(raw, 2, [1 << 40, 0]) == [None, None]
    assert whitening.deviations(np.array([[1 << 20, 3]], np.int64).tobytes(), 5, [7, -2]) == [(5 * (1 << 20) - 7) ** 2 + 17 ** 2]


# lexicon and word BPE

@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.binary(max_size=5), st.lists(st.integers(0, 9), max_size=4).map(tuple), max_size=40),
       st.lists(st.binary(max_size=6), max_size=20))
def test_transducer_is_the_mapping(tmp_path_factory, words, others):
    path = tmp_path_factory.mktemp("lexicon") / "words.bin"
    path.write_bytes(compile_lexicon(sorted(words.items())))
    ask = [*words, *others]
    known, ids, count = Transducer(str(path)).lookup(ask)
    assert known.tolist() == [w in words for w in ask]
    end = np.cumsum(count)
    assert [tuple(ids[e - n:e].tolist()) for e, n in zip(end, count)] == [words[w] for w in ask if w in words]


def test_transducer_shares_suffixes(tmp_path):
    words = [(a + b"ing", (i,)) for i, a in enumerate([b"call", b"farm", b"walk"])]
    (tmp_path / "w.bin").write_bytes(compile_lexicon(words))
    assert len(Transducer(str(tmp_path / "w.bin")).final) == 1 + 9 + 3 + 1  # root, own letters, "in" of "ing" shared, end


def test_word_bpe_matches_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(VOCAB))
    rng = random.Random(11)
    pool = ["a", "é", "É", "Σ", "İ", "́", "ﬃ", "가", "ᄀ", "ᅡ", "'s", "'LL", "<|endoftext|>", "<|", "|>", "\x1c", "\x85", "\xa0", " ",
            " ", "\n", "9", "²", "…", "!", "\0", "😀", "ing", "The"]
    texts = [None, "", "  ", "x" * 64, "x" * 65, "ab" * 3000, "." * 999, "word " * 40000,
             *("".join(rng.choices(pool, k=rng.randint(1, 30))) for _ in range(3000))]
    df = spark.createDataFrame([(i, t, "c", 1, 2) for i, t in enumerate([*texts, "twice"])] + [(len(texts), "twice", "c", 1, 2)],
                               "doc_id long, text string, word string, n long, ids int")
    for share in (0.5, 1e-3, 1e-9):  # a lexicon of almost no word, of some, of all: the same result
        got = word_bpe.encode_decode(df, ["doc_id"], VOCAB, digests=True, share=share).collect()
        assert len(got) == len(texts) + 2
        for r in got:
            ids = tok.encode((texts + ["twice"])[r.doc_id] or "", add_special_tokens=False).ids
            assert r.n_tokens == len(ids)
            assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    r = word_bpe.encode_decode(df.where("doc_id = 7"), ["doc_id"], VOCAB).first()
    assert np.frombuffer(r.ids, "<u4").tolist() == tok.encode(texts[7], add_special_tokens=False).ids
    assert word_bpe.encode_decode(df.where("false"), ["doc_id"], VOCAB).collect() == []


def test_word_counts_are_exact_over_flushes(spark, monkeypatch):
    df = spark.createDataFrame([("a b a",), (None,), ("A c.",)], "text string")
    monkeypatch.setattr(word_bpe, "FLUSH", 1)
    assert {bytes(r.word): r.n for r in word_bpe.word_counts(df, VOCAB).collect()} == {b"a": 3, b"b": 1, b"c": 1, b".": 1}


# conversation repair

def cheapest(initials, forced, cut):
    """Least (cost, audit) over all ways, by exhaustive recursion."""
    @functools.lru_cache(None)
    def rest(i, state, inserted):
        ways = [(0, "")] if i == len(initials) and state in (repair.START, repair.ASSISTANT) else []
        def then(cost, edit, to):
            ways.extend((c + cost, edit + a) for c, a in ([to] if to else []))
        if inserted < 2:
            then(2, "I", rest(i, repair.DUE[state], inserted + 1))
        if i < len(initials):
            then(3, "D", rest(i + 1, state, 0))
            if not forced[i]:
                if (to := repair.NEXT[state].get(initials[i])) is not None:
                    then(cut[i], "K", rest(i + 1, to, 0))
                then(2 + cut[i], "R", rest(i + 1, repair.DUE[state], 0))
        return min(ways, default=None)
    return rest(0, repair.START, 0)


def expected(rows):
    """Result of (conv_id, turn, role, text) rows, straight from the rules."""
    out, damaged = {}, {}
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        mine = damaged.setdefault(c, [])
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if code == 0:
            continue
        x = "" if code == 1 else x.translate(str.maketrans("", "", ".!?")) if code == 2 else x
        r = "user" if code == 4 else r
        mine += [(t, r, x)] * (2 if code == 3 else 1)
    for c, mine in damaged.items():
        mine.sort(key=lambda m: (m[0] is not None, m[0] or 0, m[1], m[2]))
        seen, forced, cut, counts = set(), [], [], [0, 0, 0]
        for _, r, x in mine:
            body = x.strip(" \t\n\x0b\x0c\r")
            fault = 0 if not body else 1 if (r, x) in seen else 2 if body[-1] not in ".!?" else None
            seen.add((r, x))
            if fault is not None:
                counts[fault] += 1
            forced.append(fault in (0, 1))
            cut.append(fault == 2)
        turns = {t for t, _, _ in mine if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [r[:1] for _, r, _ in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = cheapest(initials, tuple(forced), tuple(cut))
        rows_left = repair.edited(audit, iter([(r, x) for _, r, x in mine]), repair.START)
        done = "\n".join(f"{r}:{x}" for r, x, _ in rows_left)
        out[c] = (gaps, *counts, illegal, cost, audit, hashlib.sha256(done.encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(17)
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (-1, 3, "user", None), (-2, None, "assistant", "A.")]
    for c in range(300):
        kind = rng.choice(["sua", "ua", "u", "s", "sua x", "aus"])
        for t in range(rng.randint(1, 13)):
            role = {"s": "system", "u": "user", "a": "assistant", " ": None, "x": "tool"}[rng.choice(kind)]
            text = rng.choice(["", " \n", None, "Yes.", "No", f"said {t}!", f"went {t} ", f"é{t}? ", "x" * 3000 + "."])
            rows.append((c, rng.choice([t, t, t, t + 3, None]), role, text))
    return rows + rows[100:120]


@pytest.mark.parametrize("block", [1, 3, 32])
def test_repair_matches_exhaustive_search(spark, talks, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    df = spark.createDataFrame([(*t, 1, "k", "s") for t in talks],
                               "conv_id long, turn long, role string, text string, gone int, conv string, audit string")
    rows = repair.damaged(df)
    # the block size lives in this process: stream the same rows through here as well as through Spark's workers
    want = expected(talks)
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair(rows).collect()}
    assert got == want
    all_rows = [r for r in rows.collect() if not r.gone]
    for c in [None, *range(0, 300, 7)]:
        one = repair.Conversation()
        mine = [r for r in all_rows if r.conv == c]
        for r in sorted(mine, key=lambda r: (r.turn is not None, r.turn or 0, r.role, r.text)):
            one.add(r.turn, r.role, r.text)
        assert one.summary() == want[c]


def test_repaired_turns_are_what_was_hashed(spark, talks):
    rows = repair.damaged(spark.createDataFrame(talks, "conv_id long, turn long, role string, text string"))
    audits = repair.repair(rows).cache()
    turns = {}
    for r in repair.repaired_turns(rows, audits).orderBy("conv_id", "place").collect():
        turns.setdefault(r.conv_id, []).append(r)
    for a in audits.collect():
        mine = turns.get(a.conv_id, [])
        assert [r.place for r in mine] == list(range(len(mine)))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in mine).encode()).hexdigest() == a.repaired_sha256
        assert "".join(r.edit for r in mine) == a.audit.replace("D", "")
        roles = "".join(r.role[0] for r in mine)
        assert roles.removeprefix("s") == "ua" * (len(roles) // 2) and roles != "s"


def test_long_conversation_and_empty_table(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"Turn {t % 90}.") for t in range(200)]
    short = repair.repair(repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert tuple(short)[1:] == expected(rows)[1]
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"Turn {t % 900}.") for t in range(5000)]
    got = repair.repair(repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert len(got) == 1 and len(got[0].audit) >= 4700 and got[0].duplicate > 3000
    assert repair.repair(repair.damaged(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).collect() == []


def test_seen_runs_merge():
    seen = repair.Seen()
    keys = [hashlib.blake2b(str(i).encode(), digest_size=16).digest() for i in range(150_000)]
    assert all(seen.add(k) for k in keys) and not any(seen.add(k) for k in keys[::97])
    assert len(seen.runs) <= math.ceil(math.log2(150_000))


def test_bound_never_exceeds_the_cost():
    rng = random.Random(23)
    for _ in range(800):
        n = rng.randint(0, 8)
        initials = [rng.choice("suax") for _ in range(n)]
        forced = [rng.random() < 0.3 for _ in range(n)]
        cut = [rng.random() < 0.4 and not f for f in forced]
        assert repair.weights(initials, forced, cut)[0] <= cheapest(initials, tuple(forced), tuple(cut))[0]
        assert repair.search(initials, forced, cut, {repair.START: (0, "")}, True)[0][:2] == cheapest(initials, tuple(forced), tuple(cut))


def test_byte_characters_equal_the_tokenizer_file():
    with open(public_tokenizers.path(VOCAB), encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    assert sorted(word_bpe.byte_chars()) == sorted(p for p, i in vocab.items() if i < 256)
