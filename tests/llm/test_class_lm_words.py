"""Classes of words that aren't units: their own contexts, against brute force."""

import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import class_lm as c
from tests.llm.test_class_lm import brute_tokens

SMALL = c.Shape(units=6, groups=3, classes=5, rounds=6, dictionary=20, block=300, least=2)


def texts(seed, n=120):
    rng = np.random.default_rng(seed)
    sides = [[f"a{i}" for i in range(40)] + ["x" * 80], [f"b{i}" for i in range(40)] + ["y" * 90]]
    weight = 1 / np.arange(1, 42)
    rows = []
    for i in range(n):
        words = [sides[(k + i) % 2][rng.choice(41, p=weight / weight.sum())] for k in range(rng.integers(1, 40))]
        rows.append((i, " ".join(words)))
    return [*rows, (None, "a0 b0"), (500, ""), (501, None), (502, "new " + "z" * 3000)]


def model_of(spark, rows, shape):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    docs = df.withColumn("held_out", c.held_out(F.col("doc_id")))
    model, counts, classed = c.learn(docs, shape)
    return model, {bytes(r.word): r for r in counts.collect()}, c.score_classed(classed, model).collect(), docs, counts


def class_of(model, counts, word):
    if word is None:
        return int(model.classes[-1])
    if word in model.words[: SMALL.units]:
        return int(model.classes[model.words.index(word)])
    if word in counts and counts[word]["class"] is not None:
        return counts[word]["class"]
    return int(model.classes[SMALL.units + zlib.crc32(word[:2] + b" " + word[-2:]) % SMALL.groups])


def training(rows):
    return [brute_tokens(t) for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]


def table(train, cls):
    out = np.zeros((SMALL.classes,) * 2, np.int64)
    for ts in train:
        for a, b in zip([None, *ts], ts, strict=False):
            out[cls(a), cls(b)] += 1
    return out


def test_scores_against_brute_force(spark):
    rows = texts(3)
    model, counts, got, docs, every = model_of(spark, rows, SMALL)
    train = training(rows)
    count = Counter(w for ts in train for w in ts)
    cls = lambda w: class_of(model, counts, w)
    own = [w for w, r in counts.items() if r["class"] is not None]
    assert set(own) == {w for w, n in count.items() if w is not None and n >= 2 and w not in model.words[: SMALL.units]}
    assert any(len(w) > c.LONGEST for w in own)
    pairs = table(train, cls)
    n, v, unseen = sum(count.values()), len(count), max(1, sum(m == 1 and w is not None for w, m in count.items()))
    unseen /= n + unseen

    def p(word, before):
        if word not in count:
            return unseen
        a, b = cls(before), cls(word)
        return (1 - unseen) * (pairs[a, b] + SMALL.smooth * pairs[:, b].sum() / n) / (pairs[a].sum() + SMALL.smooth) * count[word] / pairs[:, b].sum()

    for before in [None, *list(count)[:5], b"never seen"]:
        assert abs(sum(p(w, before) for w in count) + unseen - 1) < 1e-9
    want = []
    for i, t in rows:
        ts = brute_tokens(t)
        log = sum(math.log10(p(w, a)) for a, w in zip([None, *ts], ts, strict=False))
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ts)
        want.append((i, len(ts), sum(w in count for w in ts), round(base, 5), round(log, 5), round(10 ** (-log / len(ts)), 3)))
    shown = lambda rows: sorted(((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 5), round(r.score, 5), round(r.perplexity, 3)) for r in rows), key=str)
    assert shown(got) == sorted(want, key=str)
    assert shown(c.score(docs, model, every).collect()) == shown(got)


def test_own_contexts_raise_the_likelihood(spark):
    """Words of two sides that take turns: groups by hash mix the sides, own contexts part them."""
    rows = texts(4, 300)
    model, counts, *_ = model_of(spark, rows, SMALL)
    train = training(rows)
    group = lambda w: class_of(model, {}, w)
    own = lambda w: class_of(model, counts, w)
    assert c.likelihood(table(train, own)) > c.likelihood(table(train, group))
    a, b = (Counter(own(w) for w, r in counts.items() if r.n >= 8 and w.startswith(side)) for side in (b"a", b"b"))
    assert sum(min(a[k], b[k]) for k in range(SMALL.classes)) <= 0.1 * (a.total() + b.total())  # a class holds words of one side


def test_rounds_never_lower_the_likelihood(spark):
    rng = np.random.default_rng(5)
    n = SMALL.size
    a, b = np.divmod(np.arange(n * n), n)
    flow = rng.poisson(3, (n, n))
    rows = [(int(i), int(j), int(m)) for i, j, m in zip(a, b, (flow + flow.T)[a, b], strict=True) if m]
    pairs = spark.createDataFrame(rows, "a int, b int, n long")
    found = []
    for rounds in range(6):
        shape = c.Shape(units=6, groups=3, classes=5, rounds=rounds)
        classes, bigrams = c.exchange(pairs, shape, gain=-1.0)
        again = np.zeros((5, 5), np.int64)
        for i, j, m in rows:
            again[classes[i], classes[j]] += m
        assert (again == bigrams).all()
        found.append(c.likelihood(bigrams))
    assert found == sorted(found)


def test_best_classes_against_the_likelihood():
    """A word that has no neighbour of its own present class is weighed exactly."""
    rng = np.random.default_rng(6)
    for _ in range(30):
        bigrams = rng.poisson(20, (5, 5)) + 30
        bigrams = bigrams + bigrams.T
        at = int(rng.integers(0, 5))
        left = rng.poisson(2, 5)
        left[at] = 0
        if not left.any():
            continue
        right = rng.permutation(left[np.arange(5) != at])
        right = np.insert(right, at, 0)
        rest = bigrams.copy()
        rest[:, at] -= left
        rest[at, :] -= right
        tries = []
        for k in range(5):
            moved = rest.copy()
            moved[:, k] += left
            moved[k, :] += right
            total = bigrams.sum(0).astype(float)
            total[at] -= left.sum()
            total[k] += left.sum()
            tries.append(c.x_log_x(moved).sum() - 2 * c.x_log_x(total).sum())
        best = int(c.best_classes(np.concatenate([left, right])[None, :], np.array([at]), bigrams)[0])
        assert tries[best] >= max(tries) - 0.6


def test_hot_word_over_many_rows(spark):
    """A word's rows that go over several Arrow batches are one word."""
    entry = np.array([(1, 1), (5 + 2, 1)], c.CONTEXT).tobytes()
    rows = spark.range(25_000).select(F.lit(b"hot").alias("word"), F.lit(entry).alias("contexts")).unionByName(spark.createDataFrame([(b"cold", entry), (b"rare", entry), (b"cold", entry)], "word binary, contexts binary"))
    got = c.own_classes(rows, np.arange(SMALL.size) % 5, np.full((5, 5), 100_000), SMALL).collect()
    assert sorted((bytes(r.word), r.n, r["class"] is None) for r in got) == [(b"cold", 2, False), (b"hot", 25_000, False), (b"rare", 1, True)]


def test_whole_vocabulary_of_the_documents(spark):
    """Words with a class of their own make up nearly all training tokens."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").withColumn("held_out", c.held_out(F.col("doc_id")))
    model, counts, _ = c.learn(docs, c.PRODUCTION)
    r = counts.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("class").isNotNull(), F.col("n"))).alias("own")).first()
    units = int(model.known[: model.shape.units].sum()) + model.ends
    assert r.n + units == model.n_tokens and r.n - r.own == counts.where("n = 1").count() > 0
