import numpy as np

from tessera.llm import topk


def brute(rows, queries, k):
    out = {}
    for q, x in queries:
        scored = sorted((-sum(a * b for a, b in zip(x, y, strict=False)), i) for i, y in rows if i != q)
        out[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 37)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(3)
    rows = [(i, [int(v) for v in rng.integers(-3, 4, 5)]) for i in range(400)]  # many ties
    rows += [(900 + i, [1024] * 5) for i in range(60)]  # a hot vector
    rows += [(1000, [5]), (1001, [10**9] * 6)]  # another length; scores beyond a float's integers
    queries = rows[::20] + rows[-2:]
    df = spark.createDataFrame(rows, "id long, vector array<long>")
    asked = spark.createDataFrame(queries, "id long, vector array<long>")
    assert answers(topk.top_k(df, asked, 10)) == brute(rows, queries, 10)


def test_fewer_rows_than_k_and_empty(spark):
    rows = [(1, [1, 2]), (2, [3, 4]), (3, [-5, 0])]
    df = spark.createDataFrame(rows, "id long, vector array<long>")
    assert answers(topk.top_k(df, df, 10)) == brute(rows, rows, 10)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0
    assert topk.top_k(df, df.limit(0)).count() == 0
    one = df.limit(1)
    assert topk.top_k(one, one).count() == 0


def test_odd_vectors_take_no_part(spark, tmp_path):
    rows = [(0, [0.5, 0.25]), (100, None), (200, [float("nan"), 1.0]), (300, [None, 1.0]), (400, [float("inf"), 1.0]), (500, []), (None, [1.0, 1.0]), (7, [1.0, -1.0]), (8, [1.0, -1.0]), (8, [1.0, -1.0])]
    spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert answers(topk.op10_exact_topk(spark, str(tmp_path))) == {0: [(1, 7, 512 * 1024 - 256 * 1024), (2, 8, 262144), (3, 8, 262144)]}
