import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import class_lm as c

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_tokens(text):
    return [*(w.encode() for w in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))), None]


SMALL = c.Shape(units=40, groups=8, classes=6, rounds=4, dictionary=60, block=500)


def brute_unit(model, word):
    if word is None:
        return SMALL.units + SMALL.groups
    return model.words.index(word) if word in model.words[: SMALL.units] else SMALL.units + zlib.crc32(word[:2] + b" " + word[-2:]) % SMALL.groups


def check(rows, got, model):
    train = [(i, brute_tokens(t)) for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(w for _, ts in train for w in ts)
    n, v = sum(count.values()), len(count)
    assert (model.n_tokens, model.n_words) == (n, v)
    pairs, sums = Counter(), Counter()
    cls = lambda w: int(model.classes[brute_unit(model, w)])
    for _, ts in train:
        for a, b in zip([None, *ts], ts, strict=False):
            pairs[cls(a), cls(b)] += 1
            sums[cls(b)] += 1
    lead = Counter(a for (a, _), m in pairs.items() for _ in range(m))
    unseen = max(1, sum(m == 1 and w is not None for w, m in count.items()))
    unseen = unseen / (n + unseen)

    def p(word, before):
        if word not in count:
            return unseen
        a, b = cls(before), cls(word)
        step = (pairs[a, b] + SMALL.smooth * sums[b] / n) / (lead[a] + SMALL.smooth)
        return (1 - unseen) * step * count[word] / sums[b]

    for before in [None, *list(count)[:5], b"never seen"]:
        assert abs(sum(p(w, before) for w in count) + unseen - 1) < 1e-9
    want = []
    for i, t in rows:
        ts = brute_tokens(t)
        score = sum(math.log10(p(w, a)) for a, w in zip([None, *ts], ts, strict=False))
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ts)
        want.append((i, i is None or zlib.crc32(str(i).encode()) % 7 == 2, len(ts), sum(w in count for w in ts), n, round(base, 5), round(score, 5)))
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in got), key=str) == sorted(want, key=str)


def run(df):
    docs = df.select("doc_id", "text").withColumn("held_out", c.held_out(F.col("doc_id")))
    model, counts = c.fit(docs.where(~F.col("held_out")).select("text"), SMALL)
    return c.score(docs, model, counts).collect(), model


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    sides = [["ab", "cd", "éf", "gh"], ["Xy", "zw", "uv"]]
    rows = []
    for i in range(80):
        words = [sides[(k + i) % 2][rng.integers(0, 3)] + (str(rng.integers(0, 40)) if rng.random() < 0.4 else "") for k in range(rng.integers(1, 60))]
        rows.append((i, "\n ".join(words)))
    rows += [(None, "ab cd"), (None, "ab cd"), (5, rows[5][1]), (100, ""), (101, None), (102, "w" * 5000 + " ab"), (103, "w" * 5000), (104, "  \t"), (105, "\x00 ab\x00")]
    got, model = run(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    check(rows, got, model)
    held = [r for r in got if r.held_out and r.n_tokens > 5]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_best_class_against_the_likelihood():
    rng = np.random.default_rng(2)
    for _ in range(20):
        pairs = rng.poisson(2, (12, 12))
        classes = rng.integers(0, SMALL.classes, 12)

        def likelihood(classes, pairs=pairs):
            n = np.zeros((SMALL.classes, SMALL.classes))
            np.add.at(n, (classes[:, None].repeat(12, 1), classes[None, :].repeat(12, 0)), pairs)
            return c.x_log_x(n).sum() - c.x_log_x(n.sum(0)).sum() - c.x_log_x(n.sum(0)).sum()

        # a chain, as texts are: as many pairs lead to a unit as from it
        pairs = pairs + pairs.T
        n = np.zeros((SMALL.classes, SMALL.classes), np.int64)
        np.add.at(n, (classes[:, None].repeat(12, 1), classes[None, :].repeat(12, 0)), pairs)
        u = 3
        before, after = (np.bincount(classes, w, SMALL.classes).astype(int) for w in (pairs[:, u], pairs[u]))
        best = c.best_class(before, after, pairs[u, u], pairs[u].sum(), classes[u], n, n.sum(0))
        tries = []
        for k in range(SMALL.classes):
            moved = classes.copy()
            moved[u] = k
            tries.append(likelihood(moved, pairs))
        assert tries[best] >= max(tries) - 1e-5


def test_frequent_words(spark):
    df = spark.createDataFrame([(b"w%d" % i, 1000 - i) for i in range(50)] + [(b"x" * 65, 5000)] + [(b"t%d" % i, 7) for i in range(40)], "word binary, n long")
    assert [bytes(r.word) for r in c.frequent(df, 1000)][:3] == [b"w0", b"w1", b"w2"] and len(c.frequent(df, 1000)) == 90
    assert len(c.frequent(df, 60)) == 50 and 0 < len(c.frequent(df, 30)) <= 30 and c.frequent(df.limit(0), 5) == []


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert run(df)[0] == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (row,), _ = run(spark.createDataFrame([(held, "a b")], "doc_id long, text string"))
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)


def test_query(spark):
    got = c.op1_class_lm(spark, "/root/testdata/sf0.01").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 1000 and sum(r.score for r in held) > 0.95 * sum(r.base_score for r in held)
