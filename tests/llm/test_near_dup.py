import random
import re

import numpy as np
import pytest

from tessera.llm import near_dup as n
from tessera.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_set(text, width=4):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words)} if 0 < len(words) < width else {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, percent=80):
    sets = [(i, brute_set(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def brute_signature(found):
    slots = n.ROWS * n.BANDS
    mask, out = (1 << 64) - 1, [int(n.UNSET)] * slots

    def mixed(x):
        return int(n.mixed(np.array([x], np.uint64))[0])

    for e in found.tolist():
        p = list(range(slots))
        for rank in range(slots):
            draw = mixed((e + (2 * rank + 1) * 0x9E3779B97F4A7C15) & mask)
            k = rank + mixed(draw) % (slots - rank)
            p[rank], p[k] = p[k], p[rank]
            out[p[rank]] = min(out[p[rank]], (rank << 56) | (draw >> 8))
    return out


def test_signature_against_elementwise():
    rng = np.random.default_rng(1)
    sets = [np.sort(rng.integers(0, 2**63, k).astype(np.uint64)) for k in (1, 3, 40, 300)]
    assert [s.tolist() for s in n.signatures(sets)] == [brute_signature(s) for s in sets]
    large = [np.sort(rng.integers(0, 2**63, 6000).astype(np.uint64)) for _ in range(5)]
    assert (n.signatures(large)[2] == n.signatures([large[2]])[0]).all()


def test_signature_estimates_similarity():
    rng = np.random.default_rng(2)
    x = np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64))
    s = n.signatures([x[:900], x[100:]])
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.12


def test_shared_counts():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64)) for _ in range(30)]
    for columns in (7, 20_000):
        got = n.shared_counts(sets[:12], sets[5:], columns)
        assert (got == [[len(np.intersect1d(a, b)) for b in sets[5:]] for a in sets[:12]]).all()
    assert (n.shared_counts([sets[0]], [sets[1] + np.uint64(1000)]) == 0).all()


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(500, 500 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    for _ in range(200):
        for a, b in edges:
            m = min(root.get(a, a), root.get(b, b))
            root[a] = root[b] = m
    assert got == {k: v for k, v in root.items() if any(a != b and k in (a, b) for a, b in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    rows, passage = [], [word() for _ in range(60)]
    for g in range(12):
        base = [word() for _ in range(rng.randint(20, 150))]
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy).upper() if g % 3 else " \n".join(copy))
    for _ in range(40):  # a passage that many share makes no link
        rows.append(" ".join([*(word() for _ in range(40)), *passage]))
    chain = [word() for _ in range(100)]
    for k in range(15):  # neighbours are similar, ends are not
        rows.append(" ".join([*chain[4 * k :], *chain[: 4 * k]][:100]) if k % 2 else " ".join(chain[3 * k : 3 * k + 70]))
    rows += ["one two", "One  two ", "one", "", None, " \t\n", "Straße Äpfel", "straße äpfel", "straße Äpfel"]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return list(zip(order, rows, strict=True))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in n.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("bands", [1, 8])
def test_blocks_reach_every_pair(spark, bands):
    """With one slot a band the buckets hold many documents that are not similar."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    copies = []
    for _ in range(60):  # from hardly to heavily edited
        copy = list(base)
        for _ in range(rng.randint(0, 9)):
            copy[rng.randrange(len(copy))] = f"x{rng.random()}"
        copies.append(" ".join(copy))
    rows = corpus(5) + [(1000 + i, t) for i, t in enumerate(copies)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in n.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), rows=1, bands=bands, part=700).collect()}
    want = brute(rows)
    if bands == 8:
        assert got == want
    else:  # few pairs share the only slot, but all of those are found or joined
        sketches = [(i, n.shingles((t or "").encode(), n.WordHashes())) for i, t in rows]
        full = [(i, s, int(n.signatures([s], 1)[0, 0])) for i, s in sketches if len(s)]
        for k, (i, a, x) in enumerate(full):
            for j, b, y in full[k + 1 :]:
                same = len(np.intersect1d(a, b))
                if x == y and 100 * same >= 80 * (len(a) + len(b) - same):
                    assert got[i][1] == got[j][1]


def test_edges(spark):
    text = " ".join(f"w{i}" for i in range(50_000))
    rows = [(None, "a b c d e", 1), (None, "a b c d e", 1), (4, "a b c d e", 1), (3, "A b c d  e", 1), (3, "x y z", 1), (9, "x y z", 1), (9, "x y z", 1), (1, text, 1), (2, text + " end", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long")
    out = n.near_duplicates(df)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out.collect()), key=str)
    assert got == sorted([(None, 2, None, True)] * 2 + [(4, 2, 3, False), (3, 2, 3, True), (3, 1, 3, True), (9, 1, 3, False), (9, 1, 3, False), (1, 49_997, 1, True), (2, 49_998, 1, False)], key=str)
    assert n.near_duplicates(df.limit(0)).count() == 0


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in n.op2_near_dup(spark, "/root/testdata/sf0.001").collect()}
    assert got == brute(rows)
