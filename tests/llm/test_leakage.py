import random
import re

import numpy as np
from pyspark.sql import functions as F

from recollary.llm import leakage


def brute(docs, items, run=13):
    word = re.compile(r"[^\W_]+")
    cut = lambda t: [w.lower() for w in word.findall(t or "")]
    out = set()
    for i, t in items:
        w = cut(t)
        wanted = {tuple(w[k : k + run]) for k in range(len(w) - run + 1)}
        for d, u in docs:
            v = cut(u)
            if any(tuple(v[k : k + run]) in wanted for k in range(len(v) - run + 1)):
                out.add((d, i))
    return out


def test_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(12)]  # few words, so that n-grams are frequent and partly shared
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([4, 12, 13, 30, 60]))) for i in range(25)] + [(90, None), (91, "")]
    docs = []
    for d in range(300):
        body = text(rng.randint(0, 120)).split()
        if d % 3 == 0:
            _, t = rng.choice(items[:25])
            w = t.split()
            a = rng.randint(0, max(0, len(w) - 1))
            body[len(body) // 2 : len(body) // 2] = [x.upper() if rng.random() < 0.5 else x + rng.choice([",", "**", "\r\n", " -"]) for x in w[a : a + rng.choice([12, 13, 14, 40])]]
        docs.append((d, " ".join(body)))
    docs += [(900, None), (901, ""), (902, docs[0][1])]
    a = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"gram": F.lit(1), "item_id": F.lit(2), "p": F.lit(3)})
    b = spark.createDataFrame(items + items[:3], "item_id long, text string").withColumns({"gram": F.lit(1), "doc_id": F.lit(2)})
    got = leakage.leaks(a, b)
    assert {(r.doc_id, r.item_id) for r in got.where("longest_run >= 13").collect()} == brute(docs, items)
    assert leakage.leaks(a.limit(0), b).count() == 0 and leakage.leaks(a, b.limit(0)).count() == 0


def test_edited_copies_are_scored(spark):
    rng = random.Random(6)
    item = [f"word{i}" for i in range(40)]
    edited = list(item)
    edited[10] = "changed"
    del edited[25]
    docs = [(1, " ".join(["x"] * 30 + edited + ["y"] * 30)), (2, " ".join(f"other{rng.random()}" for _ in range(90))), (3, " ".join(item))]
    got = {r.doc_id: r for r in leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()}
    assert set(got) == {1, 3}
    assert 0.85 < got[1].score < 1 and got[3].score == 1 and got[3].longest_run == 40


def test_edited_copies_without_a_run(spark):
    item = [f"word{i}" for i in range(40)]
    edited = [f"new{i}" if i % 10 == 9 else w for i, w in enumerate(item)]
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    one = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    docs = [(1, " ".join(["x"] * 30 + edited + ["y"] * 30)), (2, "word0 word1 word2 other words")]
    # alone in the corpus, and beside an exact copy, which holds the rarer n-grams of every window
    for more in ([], [(3, " ".join(item))]):
        got = {r.doc_id: r for r in leakage.leaks(table(docs + more), one).collect()}
        assert set(got) == {1} | {d for d, _ in more}
        assert 0.75 < got[1].score < 1 and got[1].longest_run == 9


def test_align():
    a, b = np.array([1, 2, 3, 4]), np.array([9, 1, 2, 8, 3, 4, 9])
    best, longest = leakage.align([(a, b), (a, a), (b, np.array([7]))])
    assert best.tolist() == [17, 20, 0] and longest.tolist() == [2, 4, 0]


def smith_waterman(a, b):
    h, r = np.zeros((len(a) + 1, len(b) + 1), dtype=int), np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            same = a[i - 1] == b[j - 1]
            h[i, j] = max(0, h[i - 1, j - 1] + (5 if same else -3), h[i - 1, j] - 3, h[i, j - 1] - 3)
            r[i, j] = r[i - 1, j - 1] + 1 if same else 0
    return h.max(), r.max()


def test_stretches_lose_nothing():
    rng = np.random.default_rng(3)
    pairs = []
    for _ in range(150):
        a = rng.integers(0, 12, rng.integers(1, 30))
        b = rng.integers(-14, 12, rng.integers(0, 90)).clip(-1)
        at = rng.integers(0, len(b) + 1)
        part = a[rng.integers(0, len(a)) :][: rng.integers(0, 20)]
        pairs.append((a, np.concatenate((b[:at], part, b[at:]))))
    best, longest = leakage.align_within(pairs)
    want = [smith_waterman(a, b) for a, b in pairs]
    assert best.tolist() == [int(s) for s, _ in want] and longest.tolist() == [int(r) for _, r in want]


def test_recall_of_edited_copies(spark):
    """Every 6th to 12th word changed, left out or put in; no exact copy in the corpus, and much boilerplate."""
    rng = random.Random(9)
    common = [f"c{i}" for i in range(60)]
    word = lambda: rng.choice(common) if rng.random() < 0.5 else f"w{rng.randrange(4000)}"
    items = [(i, [word() for _ in range(rng.randint(20, 110))]) for i in range(40)]
    docs, want = [], set()
    for d in range(600):
        body = [word() for _ in range(rng.randint(0, 300))]
        if d % 2 == 0:
            i, w = items[d // 2 % 40]
            every, kind = rng.randint(6, 12), rng.choice("cdi")
            made = []
            for k, x in enumerate(w):
                hit = k % every == every - 1
                made += [f"new{d}_{k}"] if hit and kind == "c" else [] if hit and kind == "d" else [x, f"new{d}_{k}"] if hit else [x]
            at = rng.randint(0, len(body))
            body[at:at] = made
            want.add((d, i))
        docs.append((d, " ".join(body)))
    found = leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in leakage.copies(found).where("edited").collect()}
    assert len(got & want) >= 0.99 * len(want) and len(got & want) >= 0.99 * len(got)
