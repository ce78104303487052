"""The operators on small tables: nulls, empty texts, repeated rows, clashing columns, empty tables, brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from opsledger.llm import (byte_bpe, chat_snapshots, chosen_path, decontaminate, language_mixture, line_dedup, quality_rules, secret_forest,
                           suffix_family, warc_index)

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, root string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    vocab = ["w%d" % i for i in range(3000)]
    out = [(1, None), (2, ""), (3, "alpha beta"), (4, "ALPHA beta"), (5, "alpha"), (None, "alpha beta"), (6, " \n ")]
    base = [rng.choice(vocab) for _ in range(60)]
    passage = " ".join(rng.choice(vocab) for _ in range(20))
    for i in range(10, 40):
        words = list(base) if i < 20 else [rng.choice(vocab) for _ in range(60)]
        words[rng.randrange(60)] = "z%d" % i
        out.append((i, " ".join(words[:30]) + ("\n" + passage if i % 3 == 0 else "") + "\n" + " ".join(words[30:])))
    out += [out[10], (41, out[11][1])]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(a, b, "en", "s", 0, 7, "k", "r") for a, b in rows], SHAPE).cache()


def test_near_duplicates_match_brute_force(docs, rows):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append((i, {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()))
    root = {i: i for i, _ in sets}
    for _ in sets:
        for i, a in sets:
            for j, b in sets:
                if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    got = chosen_path.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == (root[r.doc_id] if r.doc_id is not None else None)
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    assert sum(not r.kept for r in got) >= 5


def test_suffix_family_matches_brute_force(docs, rows):
    enc = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in enc:
        for s in range(len(b) - 49 if i is not None else 0):
            first[b[s:s + 50]] = min(first.get(b[s:s + 50], i), i)
    want = []
    for i, b in enc:
        m = bytearray(len(b))
        for s in range(len(b) - 49 if i is not None else 0):
            if first[b[s:s + 50]] < i:
                m[s:s + 50] = b"\1" * 50
        want.append((i, len(b), sum(m), len(re.findall(b"\1+", bytes(m))), hashlib.sha256(bytes(x for x, y in zip(b, m) if not y)).hexdigest()))
    got = [tuple(r) for r in suffix_family.removal(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and any(w[2] for w in want)


def test_lines(docs):
    got = line_dedup.decisions(docs).collect()
    assert all((r.keeper_doc_id, r.keeper_line_no) <= (r.doc_id, r.line_no) for r in got)
    passage = [r for r in got if r.doc_id % 3 == 0 and r.line_no == 1]
    assert {(r.keeper_doc_id, r.keeper_line_no) for r in passage} == {(12, 1)}
    left = line_dedup.without_copies(docs)
    assert left.columns == docs.columns and left.where("doc_id = 41").isEmpty() and not left.where("doc_id = 10").isEmpty()


def test_short_lines_are_copies_too(spark):
    long = "a line that is long enough to have been compared ever since"
    data = [(1, f"{long}\nRead more\n{chr(0x8a9e) * 6}"), (2, f"Read more\nonly here\n{chr(0x8a9e) * 6}\nx"), (3, f"{long}\nread More\nx")]
    df = spark.createDataFrame([(*r, 0) for r in data], "doc_id long, text string, n_chars int")
    got = {(r.doc_id, r.line_no): (r.keeper_doc_id, r.keeper_line_no) for r in line_dedup.decisions(df).collect()}
    assert got == {(1, 0): (1, 0), (1, 1): (1, 1), (1, 2): (1, 2), (2, 0): (1, 1), (2, 1): (2, 1), (2, 2): (1, 2), (2, 3): (2, 3),
                   (3, 0): (1, 0), (3, 1): (1, 1), (3, 2): (2, 3)}
    assert {r.doc_id: r.text for r in line_dedup.without_copies(df).collect()} == {1: data[0][1], 2: "only here\nx"}


def test_large_group_keeps_every_link(spark):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    lines = []
    for _ in range(40):  # pairs that share one template and are 0.75 to 0.8 alike; other pairs are far apart
        tail = word(60)
        lines += ["the same beginning of all " + tail, "the same beginning of all " + tail[:-7] + word(7)]
    sets = [{x[k:k + 8] for k in range(len(x) - 7)} for x in lines]
    want = {(i, j) for j in range(80) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert len(want) >= 40
    members = spark.createDataFrame([(1, i) for i in range(80)], "key long, id long")
    texts = spark.createDataFrame(list(enumerate(lines)), "id long, text string")
    groups = {}
    for r in line_dedup.rare_shingles(members, texts, 75).collect():
        groups.setdefault(r.key, set()).add(r.id)
    assert all(any({i, j} <= g for g in groups.values()) for i, j in want)
    assert max(map(len, groups.values())) < 80


def test_warc(spark):
    big, small = "<html>" + "x" * 1200 + "\r\n\r\nWARC/1.1\r\n</html>", "<p>é</p>"
    data = [(1, "http://a.b/x", big), (2, "http://a.b/x", big), (3, None, None), (4, "http://A.b/y#z\r\n", small), (5, "q", small), (None, "http://c/", big)]
    pages = spark.createDataFrame([(*r, "extra") for r in data], "page_id long, url string, html string, payload string")
    got = {r.page_id: r for r in warc_index.captures(pages).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {
        1: ("revisit", 2), 2: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("response", None), None: ("revisit", 2)}
    for i, _, h in data:
        raw = (h or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert (got[1].capture_no, got[2].capture_no, got[1].url_key) == (1, 2, "b,a)/x")


def test_chat(spark):
    t = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (3, 2, "user", None),
         (4, 0, "user", "hi"), (4, 1, "assistant", "yo"), (4, 2, "user", ""), (5, 0, "user", "hi"), (5, 1, "assistant", "yo"), (5, 2, "user", ""),
         (5, 2, "user", ""), (None, 0, "user", "x")]
    got = {r.conv_id: r for r in chat_snapshots.collapse(spark.createDataFrame([(*r, 1) for r in t], "conv_id long, turn long, role string, text string, place int")).collect()}
    assert set(got) == {3, 4} and got[4].n_copies == 2 and got[4].n_turns == 3
    assert got[4].text == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n<|im_start|>user\n<|im_end|>\n"


def test_secrets(spark):
    rng = random.Random(8)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    data = [(i, f'some words here token = "{key()}" more') for i in range(30)] + [(i, f"paid with card {rng.randrange(10**15, 10**16)} today") for i in range(30, 60)]
    data += [(60, f'let secret: "{key()}"'), (61, None), (62, "nothing")]
    df = spark.createDataFrame([(*r, "a/b", 1.0) for r in data], "doc_id long, text string, source string, label double")
    got = {r.doc_id: r.is_secret for r in secret_forest.scan(df).collect()}
    assert all(got[i] for i in range(30)) and not any(got[i] for i in range(30, 60)) and got[60] and 61 not in got


def test_assigned_values_are_candidates(spark):
    data = [(1, 'password = "correct-horse-battery-staple" # x'), (2, "db_password: p.4!s@s#w0rd, next"), (3, "see api_key=abcdefghijklmnop&x=1 now"),
            (4, "secret = 'two words'"), (5, "DB_PASSWORD2_TOKEN=Ab1!x.y#z9"), (6, "the password is secret, he said"), (7, 'id = "0123456789abcdef" ok'), (8, "token == x")]
    df = spark.createDataFrame([(*r, "a") for r in data], "doc_id long, text string, source string")
    got = {r.doc_id: (r.candidate, r.before + r.candidate + r.after) for r in secret_forest.findings(df).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "correct-horse-battery-staple", 2: "p.4!s@s#w0rd", 3: "abcdefghijklmnop&x=1", 4: "two words",
                                                5: "Ab1!x.y#z9", 7: "0123456789abcdef", 8: "x"}
    assert all(got[i][1] == t for i, t in data if i in got)


def test_copies_do_not_fill_the_training_sample(spark, monkeypatch):
    monkeypatch.setattr(secret_forest, "TRAINING_ROWS", 8)
    key = "0123456789abcdef0123456789abcdef"
    data = [(i, "paid with card 1234567890123456 today") for i in range(40)] + [(i, f'token = "{key}"') for i in range(40, 80)]
    df = spark.createDataFrame([(*r, "a") for r in data], "doc_id long, text string, source string")
    got = {r.doc_id: r.is_secret for r in secret_forest.scan(df).collect()}
    assert not any(got[i] for i in range(40)) and all(got[i] for i in range(40, 80))


def test_decontamination(spark):
    items = spark.createDataFrame([(1, "Anna has 12 apples and gives 5 of them to a friend, so how many of the apples are left"), (2, "tiny"), (3, None)],
                                  "item_id long, text string")
    data = [(1, "Intro. Anna has 12 apples and gives 5 of them to a friend, so how many of the apples are left? End."),
            (2, "ANNA HAS 30 APPLES AND GIVES 7 OF THEM TO A FRIEND, SO HOW MANY OF THE APPLES ARE LEFT"),
            (3, "A clean document about nothing in particular that shares no passage"), (4, None), (5, "tiny"), (None, "x")]
    got = {(r.doc_id, r.item_id): r.kind for r in decontaminate.leaks(spark.createDataFrame([(*r, 1) for r in data], "doc_id long, text string, at int"), items).collect()}
    assert got == {(1, 1): "verbatim", (2, 1): "reparameterised"}


def test_decontamination_of_numbers_and_edited_copies(spark):
    long = "the tank was filled for 3 days and then it was left to rest for another 3 hours so how much water had gone into it by the end"
    items = spark.createDataFrame([(1, "What is 345 + 678 * 12?"), (2, "Compute 12 + 15 + 23 + 48 - 7"), (3, long), (4, "a trip takes 3 days and 3 hours in all"),
                                   (5, "a box holds 3 red and 3 blue balls in all")],
                                  "item_id long, text string")
    data = [(1, "Homework. What is 345 + 678 * 12? Good luck."), (2, "now compute 12 + 15 + 23 + 48 - 7 please"), (3, "what is 5 + 6 * 7? compute 1 + 2 + 3 + 4 - 5"),
            (4, long.replace("3 hours", "5 hours")), (5, long.replace("3 days", "4 days").replace("3 hours", "6 hours")), (6, "a trip takes 3 days and 5 hours in all"),
            (7, "a box holds 3 red and 4 blue balls in all"), (8, "a box holds 5 red and 7 blue balls in all")]
    got = {(r.doc_id, r.item_id): (r.kind, r.n_changed) for r in decontaminate.leaks(spark.createDataFrame(data, "doc_id long, text string"), items).collect()}
    assert set(got) == {(1, 1), (2, 2), (4, 3), (5, 3), (6, 4), (7, 5)}
    assert got[1, 1] == got[2, 2] == ("verbatim", 0) and got[6, 4] == ("reparameterised", 1)


def test_map_operators_and_columns(docs, rows):
    q = quality_rules.quality_columns(docs, ["doc_id"]).collect()
    assert len(q) == len(rows) and quality_rules.good_rows(docs).columns == docs.columns
    P = pytest.importorskip("public_tokenizers")
    b = byte_bpe.encode_decode(docs, ["doc_id"], "byte_bpe_multi_50k.tiktoken", P.PATTERN).collect()
    assert sorted((r.doc_id or 0, bytes(r.decoded).decode()) for r in b) == sorted((i or 0, t or "") for i, t in rows)
    model = language_mixture.learn(docs)
    p = {r.doc_id: (r.lang_pred, r.score) for r in language_mixture.predict(docs, ["doc_id"], model).collect()}
    assert p[1] == ("und", 0.0) and p[2] == ("und", 0.0) and p[6][0] == "und" and p[12][0] == "en"


def test_empty_tables(spark, docs):
    none = docs.where("false")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    model = language_mixture.learn(none)
    for df in (chosen_path.near_duplicates(none), suffix_family.removal(none), line_dedup.decisions(none), warc_index.captures(pages), chat_snapshots.collapse(turns),
               secret_forest.scan(none), decontaminate.leaks(none, items), quality_rules.quality_columns(none, ["doc_id"]), language_mixture.predict(none, ["doc_id"], model)):
        assert df.isEmpty()
    assert decontaminate.leaks(docs, items).isEmpty()
    assert language_mixture.predict(docs, ["doc_id"], model).where(F.col("lang_pred") != "und").isEmpty()
