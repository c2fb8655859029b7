import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import divergence as d

KIND = "lang string, source string, text string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute(rows):
    """Term by term."""
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        found = TERM.findall((text or "").translate(LOWER))
        counts[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = []
    for lang, source in counts:
        kept = [t for t, n in docs[lang].items() if n >= 3]
        others = [s for x, s in counts if x == lang]

        def p(count, term):
            total = sum(count[t] for t in kept)  # noqa: B023
            return 1 + 10**9 * (count[term] + 1) // (total + len(kept))  # noqa: B023

        f = lambda x, y: (x - y) ** 2 // y
        mine, whole = counts[lang, source], sum((counts[lang, s] for s in others), Counter())
        pairs = [(-sum(f(p(mine, t), p(counts[lang, s], t)) for t in kept), s.encode()) for s in others if s != source]
        best = [(-f(p(mine, t), p(whole, t)), t.encode()) for t in kept if mine[t] and p(mine, t) > p(whole, t)]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(best)[:200])):
            out += [(lang, source, part, item.decode(), -v, n + 1) for n, (v, item) in enumerate(found)]
    return sorted(out)


def got(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aZ[`{é\x7f \x00\n")), max_size=30), max_size=5))
def test_terms(texts):
    number, words, inside = d.terms(pa.array(["x", *texts], pa.string())[1:])
    words = words.to_pylist()
    assert [(t, words[n]) for t, n in zip(inside.tolist(), number.tolist(), strict=True)] == [(i, w) for i, t in enumerate(texts) for w in TERM.findall(t.translate(LOWER))]


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 150), st.integers(1, 5), st.integers(0, 10**6))
def test_pair_sums(n_terms, n_sources, seed):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 4, (n_sources, n_terms)) * (rng.random((n_sources, 1)) < 0.8)
    totals, kept = counts.sum(1), n_terms + int(rng.integers(0, 9))
    source, term = np.nonzero(counts)
    own, number, bits = d.levels(term, source, counts[source, term], n_terms)
    p = np.array([d.share(int(c), int(totals[s]), kept) for s, c in zip(own, number)], np.int64)
    p0 = np.array([d.share(0, int(t), kept) for t in totals], np.int64)
    share = [[d.share(int(c), int(totals[s]), kept) for c in counts[s]] for s in range(n_sources)]
    want = [[sum((x - y) ** 2 // y for x, y in zip(share[a], share[b])) for b in range(n_sources)] for a in range(n_sources)]
    assert d.pair_sums(own, p, bits, p0, n_terms).tolist() == want


def some(rng, n, langs, sources):
    words = ["Ab", "cd", "éf", "漢", *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300))]
    return [(rng.choice(langs), rng.choice(sources), " ".join(words[min(len(words) - 1, int(rng.expovariate(0.02)))] for _ in range(rng.randint(0, 60)))) for _ in range(n)]


def test_against_brute_force(spark):
    rows = some(random.Random(1), 300, ["en", "de"], ["a", "b", "c", "é"])
    assert got(d.audit(spark.createDataFrame(rows, KIND).repartition(4))) == brute(rows)


def test_small_chunks_and_blocks_of_sources(spark, monkeypatch):
    monkeypatch.setattr(d, "CHUNK", 9)
    monkeypatch.setattr(d, "BLOCK", 2)
    rows = some(random.Random(2), 200, ["en", None], ["a", "b", "c", "d", "e", None])
    assert got(d.audit(spark.createDataFrame(rows, KIND).repartition(3))) == brute(rows)


def test_edges(spark):
    rows = [(None, None, None), ("", "", ""), ("en", "x", "12 . _"), ("en", "y", None), ("fr", "x", "mot " * 50_000), ("fr", "x", "mot"), ("fr", "x", "mot"), ("fr", "y", "autre"), ("it", "z", "uno")]
    df = spark.createDataFrame([(*r, "t", 5) for r in rows], KIND + ", term string, n int")
    assert got(d.audit(df)) == brute(rows)
    assert d.audit(df.limit(0)).count() == 0
