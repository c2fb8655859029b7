import itertools
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import packing as p

PATH = public_tokenizers.path(p.VOCABULARY)
LIBRARY = Tokenizer.from_file(PATH)
TOKENS = p.Tokens(PATH)


def ids_of(texts):
    out = []
    for first, flat, many in TOKENS.encode(pa.array(texts, pa.string())):
        assert first == len(out)
        stops = np.cumsum(many)
        out += [flat[a:b].tolist() for a, b in zip([0, *stops], stops, strict=False)]
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text("aB's'tRe dé É́ǅİΣσ\x1c\x85\xa0  \n1½²ſK.,<|>", max_size=40), st.sampled_from(["a<|endoftext|>b", "<|startoftext|>", " x <|endoftext|> ", "<|ENDOFTEXT|>"])), max_size=6))
def test_same_ids_as_the_library(texts):
    assert TOKENS.by_word
    assert ids_of(texts) == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_few_tokens_at_a_time(monkeypatch):
    monkeypatch.setattr(p, "BATCH_TOKENS", 7)
    monkeypatch.setattr(p, "REMEMBERED", 3)
    texts = ["", "one two three", "", "word " * 30, "x", "", "é" * 50]
    assert ids_of(texts) == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_another_vocabulary_gets_whole_texts():
    tokens = p.Tokens(public_tokenizers.path("byte_bpe_50k.json"))
    text = "Some text, with  spaces\n and é"
    assert not tokens.by_word
    assert [x[1].tolist() for x in tokens.encode(pa.array([text]))] == [Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids]


def test_patterns():
    for classes, most in ((1, 3), (7, 1), (12, 3), (20, 4)):
        want = {tuple(sorted(c)) for n in range(1, most + 1) for c in itertools.combinations_with_replacement(range(1, classes + 1), n) if sum(c) == classes}
        got = [tuple(sorted(int(v) for v in r if v)) for r in p.patterns(classes, most)]
        assert len(got) == len(set(got)) and set(got) == want


def test_least_squares_is_the_best_non_negative_fit():
    """No other step from x, along any pattern, comes nearer (the conditions of Karush, Kuhn and Tucker)."""
    rng = np.random.default_rng(1)
    for _ in range(20):
        wanted = np.concatenate([[0], rng.integers(0, 1000, 16)]).astype(float)
        made = p.patterns(16, 3)
        x = p.least_squares(made, wanted, 200)
        weight = np.arange(17) / 17
        a = np.zeros((17, len(made)))
        np.add.at(a, (made.T, np.arange(len(made))), 1)
        a *= weight[:, None]
        slope = a.T @ (a @ x - wanted * weight)
        assert (x >= 0).all() and (slope > -1e-3).all() and np.abs(slope[x > 0]).max() < 1e-3


def check_plan(histogram, capacity, slots):
    """Every piece has one place; sequences are gapless and within the capacity."""
    by_length, parts = {}, {}
    for length, first, each, sequence, offset in slots.tolist():
        by_length.setdefault(length, []).append((first, each, sequence, offset))
    for length, many in histogram.items():
        found = by_length[length]
        assert found[0][0] == 0
        for (first, each, sequence, offset), stop in zip(found, [*(f[0] for f in found[1:]), many], strict=True):
            for r in range(stop - first):
                parts.setdefault(sequence + r // each, []).append((offset + r % each * length, length))
    for inside in parts.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= capacity
    return len(parts)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), min_size=1, max_size=20), st.sampled_from([((16, 3),), ((64, 3), (8, 4)), ((5, 2),)]))
def test_plans_are_valid(histogram, grids):
    n = check_plan(histogram, 64, p.plan(histogram, 64, grids))
    assert n <= 2 * -(-sum(k * v for k, v in histogram.items()) // 64)


def test_plans_are_near_the_least_possible():
    rng = np.random.default_rng(2)
    for draw in (lambda n: rng.lognormal(6.5, 0.9, n), lambda n: rng.uniform(1, 4096, n), lambda n: rng.normal(1365, 200, n)):
        lengths = np.clip(draw(20_000).astype(int), 1, 4096)
        histogram = {int(k): int(v) for k, v in Counter(lengths.tolist()).items()}
        n = check_plan(histogram, 4096, p.plan(histogram))
        least = max(-(-int(lengths.sum()) // 4096), int((lengths > 2048).sum()))
        assert n <= 1.07 * least
    assert len(p.plan({})) == 0


def test_patterns_are_used():
    groups = p.plan_groups({30: 100, 20: 100, 14: 100, 5: 3}, 64, 32, 3)
    assert any(many >= 90 and sorted(inside, reverse=True) == [(30, 1), (20, 1), (14, 1)] for many, _, inside in groups)


def packed_rows(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for inside in by.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= capacity
    return by


def test_query_against_the_library(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = p.op13_best_fit_pack(spark, "/root/testdata/sf0.001").collect()
    by = packed_rows(rows, 4096)
    want, total = [], 0
    for i, t in texts.items():
        ids = [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        for n, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            want.append((i, n, start, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    assert len(by) <= 1.02 * -(-total // 4096) + 1


def test_edges(spark):
    rows = [(1, None, "x"), (1, "", "y"), (None, "a few words", None), (None, "a few words", None), (2, "word " * 20_000, "z"), (3, "<|endoftext|>", "w")]
    df = spark.createDataFrame([(i, t, t, s, s, s) for i, t, s in rows], "doc_id long, text string, `a.b` string, row string, length string, task string")
    pieces = p.tokenise(df, capacity=100)
    assert pieces.columns == ["doc_id", "a.b", "row", "task", "piece", "start", "length", "ids_le"]
    out = p.pack(pieces, capacity=100)
    assert out.columns == [*pieces.columns, "sequence_id", "offset"]
    got = out.collect()
    packed_rows(got, 100)
    assert [r.length for r in got if r.doc_id == 1] == [1, 1] and {r["a.b"] for r in got if r.doc_id is None} == {"a few words"}
    long = sorted((r for r in got if r.doc_id == 2), key=lambda r: r.piece)
    assert [r.start for r in long] == list(range(0, 20_001, 100)) and long[-1].length == 1
    assert b"".join(bytes(r.ids_le) for r in long) == np.array([*LIBRARY.encode("word " * 20_000).ids, 1], "<u4").tobytes()
    assert [np.frombuffer(r.ids_le, "<u4").tolist() for r in got if r.doc_id == 3] == [[49407, 1]]
    assert p.pack(p.tokenise(df.limit(0))).count() == 0


def test_one_hot_length(spark):
    df = spark.range(20_000).selectExpr("id", "if(id % 3 = 0, 7L, 1 + id % 50) AS length").repartition(16)
    got = p.pack(df, capacity=64).collect()
    by = packed_rows(got, 64)
    assert len(got) == 20_000 and len(by) <= 1.01 * sum(r.length for r in got) / 64
