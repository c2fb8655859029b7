import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as p
from tessera.llm import byte_bpe, chunk_dedup, near_dup, source_mix, toxicity

SMALL = "/root/testdata/sf0.001"
RANKS = byte_bpe.load_ranks(public_tokenizers.path(byte_bpe.VOCABULARY))
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_run_equals_the_stages_one_by_one(spark):
    """Each stage against its operator's plain meaning, on what the stage before kept."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = toxicity.fit_on_labels(spark, docs, SMALL)
    kept = [r for r in docs.collect() if model.score(r.text) < 0.5]
    assert 0 < len(kept) < docs.count()
    df = spark.createDataFrame(kept, docs.schema)
    groups = {r.doc_id: r.component_id for r in near_dup.near_duplicates(df).collect()}
    kept = [r for r in kept if groups[r.doc_id] == r.doc_id]
    assert {r.doc_id for r in kept} == set(groups.values())
    df = spark.createDataFrame(kept, docs.schema)
    cut = {r.doc_id: r.text for r in chunk_dedup.dedup(df).collect()}
    df = spark.createDataFrame([(r.doc_id, cut[r.doc_id], r.lang, r.source, len(cut[r.doc_id])) for r in kept], docs.schema)
    copies = {r.doc_id: r.copies for r in source_mix.plan_mix(df).collect()}
    want = [(r.doc_id, r.lang, r.source, TIKTOKEN.encode_ordinary(cut[r.doc_id])) for r in kept for _ in range(copies[r.doc_id])]
    assert rows(p.run(spark, SMALL)) == sorted(want, key=str)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, docs, SMALL).schema.simpleString() == docs.schema.simpleString()


def test_edges(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    data = [(1, "a text of a few words that is fine", "en", "x", 35), (1, "a text of a few words that is fine", "en", "x", 35), (None, None, None, None, None), (None, "same", "en", None, 4), (None, "same", "en", None, 4),
            (3, "", "en", "x", 0), (4, None, "en", "y", None), (5, "word " * 40_000, "en", "y", 200_000)]
    for content in (data, []):
        docs = spark.createDataFrame(content, kind)
        for name, stage in p.STAGES:
            out = stage(spark, docs, SMALL)
            n = out.count()
            assert n == (0 if not content else {"minhash_near_dedup": 7, "source_mix": n}.get(name, 8)), name


def test_texts_of_one_doc_id_are_told_apart(spark):
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(60)) for _ in range(4)]
    near = texts[0].rsplit(" ", 1)[0] + " other"
    rows = [(0, texts[0]), (0, texts[1]), (0, texts[1]), (0, ""), (-1, texts[2]), (7, near), (7, texts[3]), (8, texts[2]), (None, texts[0])]
    docs = spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in p.drop_near_duplicates(spark, docs, SMALL).collect()]
    assert sorted(got, key=str) == sorted([(0, texts[0]), (0, texts[1]), (0, ""), (-1, texts[2]), (7, texts[3]), (None, texts[0])], key=str)


def test_ids_that_decode_to_another_text_fail(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "some text", "en", "x"), (2, "", "en", "x"), (3, None, "en", "x")], "doc_id long, text string, lang string, source string")
    assert rows(p.tokenise(spark, docs, SMALL)) == [(1, "en", "x", TIKTOKEN.encode_ordinary("some text")), (2, "en", "x", []), (3, "en", "x", [])]
    encode = byte_bpe.encode

    def wrong(df, outputs=("token_ids",)):
        out = encode(df, outputs=outputs)
        return out.withColumn("decoded", F.lit("other").cast("binary")) if "decoded" in outputs else out

    monkeypatch.setattr(byte_bpe, "encode", wrong)
    with pytest.raises(Exception, match="decode"):
        p.tokenise(spark, docs, SMALL).collect()
