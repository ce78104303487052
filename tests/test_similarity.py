"""J7 segment-blocked similarity join equals brute force."""

import itertools
import random

from pyspark.sql import functions as F

from opsledger.operators.similarity import similar_pairs


def lev(a, b):
    prev = list(range(len(b) + 1))
    for i in range(1, len(a) + 1):
        cur = [i]
        for j in range(1, len(b) + 1):
            cur.append(min(cur[j - 1] + 1, prev[j] + 1, prev[j - 1] + (a[i - 1] != b[j - 1])))
        prev = cur
    return prev[-1]


def test_matches_brute_force(spark):
    rnd = random.Random(7)
    base = ["northernminerals", "southgate", "acmeores", "bluehill", "redrock", "ironworks"]
    names = []
    for i in range(300):
        w = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 3)):
            op = rnd.randint(0, 2)
            p = rnd.randint(0, len(w) - 1)
            if op == 0:
                w[p] = rnd.choice("abcxyz")
            elif op == 1:
                del w[p]
            else:
                w.insert(p, rnd.choice("abcxyz"))
        names.append((i, "".join(w), rnd.choice(["a", "b"])))
    df = spark.createDataFrame(names, "id long, name string, role string")
    got = {(r["id_a"], r["id_b"]) for r in similar_pairs(df, "id", "name", "role").collect()}
    want = {(a[0], b[0]) for a, b in itertools.combinations(names, 2)
            if a[2] == b[2] and len(a[1]) >= 5 and len(b[1]) >= 5 and lev(a[1], b[1]) <= 2}
    assert got == want
