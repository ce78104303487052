"""Operators' task-side code against brute force, without Spark."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from opsledger.llm import byte_bpe, decontaminate, kernel, language_mixture, line_dedup, links, quality_rules, suffix_family, warc_index


def texts(*values):
    return kernel.Texts.of(pa.array(list(values), pa.string()))


def brute_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i:i + 8])].append(i)
    inside = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    longest = 0
    for n in range(8, len(w)):
        grams = [tuple(w[i:i + n]) for i in range(len(w) - n + 1)]
        if len(set(grams)) == len(grams):
            break
        longest = n
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside), longest


def test_quality_rules_match_brute_force():
    rng = random.Random(1)
    docs = [None, "", " \n\t", "a", "a a a a a a a a a a a a", "é ü # $\né ü # $\n\n x"]
    for _ in range(60):
        words = [rng.choice("abc") for _ in range(rng.randrange(60))]
        docs.append(rng.choice([" ", "\n"]).join(words) + rng.choice(["", "  "]) + " ".join(words[: rng.randrange(30)]))
    got = quality_rules.measure(texts(*docs), quality_rules.Limits())
    for i, d in enumerate(docs):
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat_words")
        assert tuple(int(got[n][i]) for n in names) == brute_quality(d), d
    assert not got["kept"][got["base_failed"]].any()


@pytest.fixture(scope="module")
def codec():
    P = pytest.importorskip("public_tokenizers")
    return byte_bpe.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN), P


def test_byte_bpe_equals_tiktoken_and_round_trips(codec):
    c, P = codec
    tiktoken = pytest.importorskip("tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(c.tokens)}, special_tokens={})
    rng = random.Random(2)
    odd = ["", " ", "  a", "a ", "a  b", "a \n b", "\n\n x", "don't 12 ½ ﬁ", "a" * 3000, "\x00\x1c\x85  z", "😀👍🏽 é"]
    for _ in range(300):
        odd.append("".join(chr(rng.choice([rng.randrange(1, 128), rng.randrange(0x80, 0x2fff), rng.randrange(0x10000, 0x1ffff), 32, 10])) for _ in range(30)))
    for text, ids in zip(odd, c.encode(odd)):
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(text)
        assert c.decode(ids) == text.encode()


def test_loser_tree_merges_in_order():
    rng = random.Random(3)
    for k in (0, 1, 2, 5, 8):
        runs = [sorted((rng.randrange(20),) for _ in range(rng.randrange(9))) for _ in range(k)]
        at, out = [0] * k, []
        for r in warc_index.loser_tree(runs):
            out.append(runs[r][at[r]])
            at[r] += 1
        assert out == sorted(x for r in runs for x in r)


def test_family_bounds_over_levels(monkeypatch):
    monkeypatch.setattr(suffix_family, "BATCH", 7)
    rng, family, all_ = np.random.default_rng(4), suffix_family.Family(), []
    for _ in range(60):
        key, doc = rng.integers(0, 40, 5).astype(np.uint64), rng.integers(0, 99, 5)
        family.add(key, doc, doc)
        all_.append((key, doc))
    key, doc = (np.concatenate(x) for x in zip(*all_))
    low, high = family.bounds(key)
    for k, lo, hi in zip(key, low, high):
        assert (lo, hi) == (doc[key == k].min(), doc[key == k].max())
    assert len(family.levels) <= 8


def test_template_slots():
    t = decontaminate.Template(texts("Anna bought 12 kg of rice. Then Bob sold 3,5 km", "", None, "ÉTÉ été"))
    words = [t_ for t_ in t.slot.tolist()]
    assert words[:6] == [0, 0, 1, 3, 0, 0] and words[7:11] == [2, 0, 1, 3]
    assert t.value[-1] == t.value[-2] and t.count.tolist() == [11, 0, 0, 2]


def test_language_mixture_finds_both_languages():
    a, b = "the thing that there then with this " * 30, "der die und schlecht nicht mit auch " * 30
    start, end, cell = language_mixture.trigrams(texts(a, b))
    n = np.full((2, language_mixture.CELLS), 0.5)
    for i, x in enumerate((a, b)):
        for c in language_mixture.trigrams(texts(x))[2]:
            n[i, c] += 1
    share, known = language_mixture.mixtures(texts(a, b, a[:500] + b[:500], "", "12 !"), np.log(n / n.sum(1, keepdims=True)).astype(np.float32))
    assert share[0, 0] > 0.99 and share[1, 1] > 0.99 and 0.3 < share[2, 0] < 0.7
    assert known.tolist() == [True, True, True, False, False]


def test_block_comparison_finds_every_link():
    base = ["w%d" % i for i in range(80)]
    rng = random.Random(5)
    docs = [" ".join(w if rng.random() > 0.03 else "x%d" % rng.randrange(999) for w in base) for _ in range(30)] + ["other words here now ok fine"]
    from opsledger.llm.chosen_path import word_shingles

    block = pa.table({"odd": [False] * 31 + [True] * 31, "id": list(range(31)) * 2, "root": list(range(31)) * 2, "text": docs * 2})
    got = links.compare_block(block, word_shingles, 75)
    sets = [{tuple(d.split()[i:i + 5]) for i in range(len(d.split()) - 4)} for d in docs]
    want = {(i, j) for i in range(31) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert set(zip(got["b"].to_pylist(), got["a"].to_pylist())) == want and want


def test_similar_lines_share_a_band():
    rng, hit = random.Random(6), 0
    for n in (30, 150, 190, 195, 260, 600):
        for _ in range(20):
            line = "".join(rng.choice("abcdefgh ") for _ in range(n))
            other = line[:n // 2] + "#" + line[n // 2:]
            own, key = line_dedup.band_keys(texts(line, other))
            hit += bool(set(key[own == 0].tolist()) & set(key[own == 1].tolist()))
    assert hit >= 112


@pytest.mark.parametrize("unit, short, long", [("NaN, ", 22, 60), ("-", 30, 400), ("| --- ", 20, 90)])
def test_repetitive_lines_with_equal_sets_share_bands(unit, short, long):
    own, key = line_dedup.band_keys(texts(unit * short, unit * long, "another line"))
    assert set(key[own == 0].tolist()) <= set(key[own == 1].tolist())


def test_number_heavy_windows_match_word_for_word():
    t = decontaminate.Template(texts("What is 345 + 678 * 12?", "so: what is 345 + 678 * 12", "What is 5 + 6 * 7?"))
    at, grams = t.windows(5, 0.5)
    of = [set(grams[t.doc[at] == k].tolist()) for k in range(3)]
    assert len(of[0]) == 1 and of[0] <= of[1] and not of[0] & of[2]
