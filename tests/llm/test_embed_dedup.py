import numpy as np
import pytest

from tessera.llm import embed_dedup as e


def brute(rows, cosine=0.93):
    """{vec_id: (links, component)} for distinct vec_ids."""
    ok = [(i, np.array(v, np.float64), y) for i, v, y in rows if i is not None and y is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    root, n = {i: i for i, _, _ in rows if i is not None}, dict.fromkeys((i for i, _, _ in rows if i is not None), 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, x, a) in enumerate(ok):
        for j, y, b in ok[k + 1 :]:
            if a == b and len(x) == len(y) and i != j and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                n[i] += 1
                n[j] += 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: (n[i], find(i)) for i in n}


def got(df):
    return {r.vec_id: (r.n_links, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("block, per_list", [(2048, 4096), (11, 20)])
def test_against_brute_force(spark, monkeypatch, block, per_list):
    monkeypatch.setattr(e, "BLOCK", block)
    monkeypatch.setattr(e, "LIST", per_list)
    rng = np.random.default_rng(1)
    rows = []
    for g in range(25):
        centre = rng.normal(size=16)
        for _ in range(rng.integers(1, 25)):
            rows.append(((centre + rng.normal(size=16) * rng.choice([0.02, 0.25])).astype(np.float32).tolist(), g % 3))
    rows += [(rows[0][0], rows[0][1])] * 40 + [([float(2 * x) for x in rows[5][0]], rows[5][1])] * 3 + [(rows[0][0], 2 - rows[0][1])]
    ids = rng.permutation(len(rows)).tolist()
    rows = [(i, v, y) for i, (v, y) in zip(ids, rows, strict=True)]
    assert got(e.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))) == brute(rows)


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x = e.unit(rng.normal(size=(500, 24)) + 3 * rng.normal(size=(5, 24))[rng.integers(0, 5, 500)])
    index = e.fit(x[:200], 20_000)
    cell, codes, error = index.code(x)
    probes, true = index.probes(x, cell, 0.4), np.sqrt(e.distances(x, x))
    for c in range(len(index.centres)):
        own = cell == c
        assert (index.lower_bounds(x, c, codes[own], error[own]) <= true[:, own] + 1e-9).all()
    near = true <= 0.4
    assert probes[np.nonzero(near)[0], cell[np.nonzero(near)[1]]].all()


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [2.0, 0.0], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None), (6, None, 1), (7, [], 1), (8, [0.0, 0.0], 1), (9, [nan, 1.0], 1),
            (10, [inf, 1.0], 1), (11, [None, 1.0], 1), (12, [1.0, 0.0, 0.0], 1), (13, [1e-30, 1e-38], 1), (14, [3e38, 1e30], 1)]
    df = spark.createDataFrame(rows + [(None, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int").selectExpr("*", "0 as n_links")
    out = e.near_duplicates(df)
    assert out.count() == len(rows) + 1
    want = brute([r for k, r in enumerate(rows) if k != 2])
    assert {k: v for k, v in got(out).items() if k is not None} == want and got(out)[None] == (0, None)
    assert {r.vec_id for r in out.collect() if not r.kept} == {2, 3, 13, 14}
    assert e.near_duplicates(df.limit(0)).count() == 0


def test_query_recall(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert got(e.op6_embed_dedup(spark, "/root/testdata/sf0.1")) == brute(rows)


def test_written_bytes_do_not_grow_with_lists(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(e, "BLOCK", 100)
    monkeypatch.setattr(e, "LIST", 40)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=64).tolist(), i % 2) for i in range(2000)]
    rows += [(2000 + i, (np.array(rows[i][1]) + 0.05 * rng.normal(size=64)).tolist(), i % 2) for i in range(100)]
    written = []

    def materialise(df, name):
        written.append((name, df._jdf.queryExecution().executedPlan().toString()))
        df.write.parquet(f"{tmp_path}/{len(written)}")
        return spark.read.schema(df.schema).parquet(f"{tmp_path}/{len(written)}")

    monkeypatch.setattr(e, "materialise", materialise)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert got(e.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))) == brute([(i, np.float32(v).tolist(), y) for i, v, y in rows])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    size = sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))
    assert size < 2 * len(rows) * 64 * 4
    assert "Exchange" not in dict(written)["embed-links"]  # vectors are not sent to the lists they probe


def test_repeated_rows_in_other_batches(spark, monkeypatch):
    monkeypatch.setattr(e, "BLOCK", 5)
    rng = np.random.default_rng(4)
    base = [(rng.normal(size=8).astype(np.float32) + np.float32(0)).tolist() for _ in range(30)]
    rows = [(i % 40, base[i % 30], 0 if i % 30 < 20 else i % 3) for i in range(400)]
    df = spark.createDataFrame(rows + rows, "vec_id long, embedding array<float>, label int").repartition(7)
    once = {}
    for i, v, y in rows:
        once.setdefault((i, tuple(v), y), (i, v, y))
    want = brute_nodes(list(once.values()))
    out = got(e.near_duplicates(df))
    assert {i: c for i, (_, c) in out.items()} == {i: c for i, (_, c) in want.items()}
    assert e.near_duplicates(df).count() == 800


def brute_nodes(rows, cosine=0.93):
    """As ``brute``, for ids that may come with several vectors."""
    root = {i: i for i, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, v, a) in enumerate(rows):
        for j, w, b in rows[k + 1 :]:
            x, y = np.array(v, np.float64), np.array(w, np.float64)
            if a == b and i != j and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: (None, find(i)) for i in root}
