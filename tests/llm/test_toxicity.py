import zlib

import numpy as np
import pytest

from tessera.llm import toxicity

SMALL = "/root/testdata/sf0.01"


def brute_slots(text):
    text = f" {' '.join((text or '').lower().split())} "
    mask, out = (1 << 64) - 1, set()
    for n in toxicity.GRAMS:
        for i in range(len(text) - n + 1):
            code = ord(text[i])
            for c in text[i + 1 : i + n]:
                code = (code * 0x9E3779B97F4A7C15 + ord(c)) & mask
            out.add((((code ^ (code >> 29)) * 0xBF58476D1CE4E5B9) & mask) >> (64 - toxicity.BITS))
    return sorted(out)


@pytest.mark.parametrize("text", [None, "", "a", "Ab  c\n", "Straße 漢字 \U0001f469", "x" * 5000])
def test_slots(text):
    assert toxicity.slots(text).tolist() == brute_slots(text)


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in toxicity.op3_toxicity(spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert len(got) == docs
    for r in got.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    labels = [(got[r.doc_id].predicted, r.toxic) for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect() if r.doc_id in got and got[r.doc_id].held_out]
    assert np.mean([p == y for p, y in labels]) >= 0.95
    toxic = [p for p, y in labels if y]
    assert toxic and np.mean(toxic) >= 0.6


def test_edges(spark):
    docs = spark.createDataFrame([(i, t, 7.0) for i, t in [(1, "you idiot scum"), (2, "a nice day"), (3, None), (4, ""), (None, "idiot"), (5, "such an idiot"), (6, "fine and nice"), (1, "you idiot scum"), (7, "z" * 300_000)]], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (5, 1), (2, 0), (6, 0), (99, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs.where("doc_id is not null"), labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == 9 and rows[0].asDict().keys() == {"doc_id", "text", "score", "predicted"}
    by = {(r.doc_id, r.text): r.score for r in rows}
    assert by[(None, "idiot")] > by[(2, "a nice day")] and by[(3, None)] == by[(4, "")]
    assert toxicity.score(docs.limit(0), model).count() == 0
    none = toxicity.fit(docs, labels.limit(0))
    assert none.score("idiot") == 0.0
    assert toxicity.fit(docs, labels.where("toxic = 1")).score("") == 1.0


def test_other_columns_keep_their_names(spark):
    import numpy as np

    model = toxicity.Model(np.zeros(1 << toxicity.BITS), np.zeros(1 << toxicity.BITS), 0.0)
    df = spark.createDataFrame([(1, "t", "x", "y", 5)], "doc_id long, text string, _text string, `a.b` string, score int")
    out = toxicity.score(df, model)
    assert out.columns == ["doc_id", "text", "_text", "a.b", "score", "predicted"] and [tuple(r) for r in out.collect()] == [(1, "t", "x", "y", 0.5, 1)]
    assert toxicity.score(df, model, keep_text=False).columns == ["doc_id", "_text", "a.b", "score", "predicted"]
