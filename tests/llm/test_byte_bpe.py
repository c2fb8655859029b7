import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import byte_bpe

RANKS = byte_bpe.load_ranks(public_tokenizers.path(byte_bpe.VOCABULARY))
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_same_ids_as_tiktoken(texts):
    got = byte_bpe.Encoder(RANKS, byte_bpe.mergeable(RANKS), public_tokenizers.PATTERN).encode(texts)
    assert [list(memoryview(x).cast("I")) for x in got] == [REFERENCE.encode_ordinary(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=40), min_size=1, max_size=6), st.data())
def test_ranks_out_of_order(pieces, data):
    """Vocabularies in which a merge can make a pair of lower rank still follow the library."""
    extra = data.draw(st.lists(st.sampled_from([p[i:j] for p in pieces for i in range(len(p)) for j in range(i + 2, min(len(p), i + 6) + 1)] or [b"ab"]), unique=True, max_size=30))
    ranks = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(extra)}
    library = tiktoken.Encoding("odd", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    assert [list(memoryview(x).cast("I")) for x in byte_bpe.replay(pieces, ranks, byte_bpe.mergeable(ranks))] == [library._core_bpe.encode_single_piece(p) for p in pieces]


def test_edge_rows_round_trip(spark):
    texts = [None, "", "a" * 20_000, "repeated text, twice", "repeated text, twice", "<|endoftext|> Straße\t\n 漢字 👩‍👩‍👧", "  \x00 "]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, decoded string")
    rows = {r.doc_id: r for r in byte_bpe.encode(df, outputs=("token_ids", "ids_le", "decoded")).collect()}
    for i, t in enumerate(texts):
        assert rows[i].token_ids == REFERENCE.encode_ordinary(t or "") and bytes(rows[i].decoded) == (t or "").encode()
    assert byte_bpe.encode(df.limit(0)).count() == 0


def test_query(spark):
    want = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = byte_bpe.op5_byte_bpe(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(want)
    for r in got:
        ids = REFERENCE.encode_ordinary(want[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((want[r.doc_id] or "").encode()).hexdigest()


def test_missing_byte(tmp_path):
    (tmp_path / "v").write_bytes(b"YQ== 0\n")
    with pytest.raises(ValueError):
        byte_bpe.load_ranks(str(tmp_path / "v"))


def test_other_columns_keep_their_names(spark):
    df = spark.createDataFrame([("a b", 1, "x", "y")], "text string, _text int, `a.b` string, row string")
    out = byte_bpe.encode(df, outputs=("token_ids", "decoded"))
    assert out.columns == ["_text", "a.b", "row", "token_ids", "decoded"]
    assert [tuple(r) for r in out.collect()] == [(1, "x", "y", REFERENCE.encode_ordinary("a b"), bytearray(b"a b"))]
    assert byte_bpe.encode(df.select("text")).columns == ["token_ids"]
