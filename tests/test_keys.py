"""Exact counting by short keys, heavy hitters, row digests."""

import datetime as dt
import random
from collections import Counter
from decimal import Decimal

from pyspark.sql import functions as F

from tessera.operators import keys, profile

NAN = float("nan")


def _odd(spark):
    rows = [(1, 1.5, NAN, "a", Decimal("1.10"), True, dt.date(2020, 1, 1), dt.datetime(2020, 1, 1, 0, 0, 0, 1), [1.0], b"\x00"),
            (1, -0.0, NAN, "", Decimal("1.1"), False, None, dt.datetime(2020, 1, 1), [1.0], b"\x00"),
            (None, 0.0, 2.0, None, Decimal("-0.01"), None, dt.date(1969, 12, 31), dt.datetime(1960, 1, 1), None, b"0"),
            (2, None, None, "x" * 100, None, None, None, None, [], b""), (2, None, None, "x" * 100, None, None, None, None, [], b""),
            (3, 1.5, float("inf"), "x" * 99 + "y", Decimal("99999999.99"), True, dt.date(2020, 1, 1), None, [2.0], None)]
    return spark.createDataFrame(rows, "i int, d double, f float, s string, dec decimal(10,2), b boolean, day date, ts timestamp, arr array<double>, bin binary")


def test_key_counts_equal_full_text(spark):
    df = _odd(spark)
    want = profile.column_profile(df, profile.frequency_table(df)).orderBy("column_idx").collect()
    assert profile.column_profile(df).orderBy("column_idx").collect() == want


def _brute_top(values, k):
    return [(v, n) for v, n in sorted(Counter(v for v in values if v is not None).items(), key=lambda vn: (-vn[1], vn[0].encode()))[:k]]


def _top(df, k, columns=None):
    out = {}
    for r in profile.top_values(df, k, columns).orderBy("column_idx", "rank").collect():
        out.setdefault(r.column_name, []).append((r["value"], r["count"]))
    return out


def test_heavy_hitters_against_brute_force(spark):
    rng = random.Random(1)
    long = ["common beginning of more than thirty-two bytes " + s for s in ("a", "b", "é", "")]
    data = [(rng.choice(long), f"u{i:04d}" + "z" * 40, rng.choice("abcdé"), None, rng.choice(["", None, "q"]), i % 7) for i in range(800)]
    df = spark.createDataFrame(data, "long string, `unique.x` string, short string, none string, gaps string, n int").repartition(5)
    for k in (1, 3, 10):
        want = {c: top for j, c in enumerate(["long", "unique.x", "short", "none", "gaps"]) if (top := _brute_top([r[j] for r in data], k))}
        assert _top(df, k) == want
    assert _top(df, 2, ["n"]) == {"n": [("0", 115), ("1", 115)]}
    assert _top(df.limit(0), 3) == {}
    assert profile.top_values(df.select("n"), 3).count() == 0


def test_ties_alike_in_many_bytes(spark, monkeypatch):
    """Unique texts that share 32, 64, 128 bytes: told by further bytes, not by fetching all."""
    monkeypatch.setattr(keys, "ALIKE", 5)
    data = [("p" * 150 + f"{i:03d}", "p" * 40 + ("" if i % 3 else f"{i:03d}"), "s" if i % 2 else "p" * 70 + str(i)) for i in range(120)]
    random.Random(2).shuffle(data)
    df = spark.createDataFrame(data, "a string, b string, c string").repartition(4)
    for k in (1, 4, 30):
        assert _top(df, k) == {c: _brute_top([r[j] for r in data], k) for j, c in enumerate("abc")}


def test_no_text_in_an_exchange(spark):
    """What is exchanged for the counts is keys and heads; the digest of a row is its whole exchange."""
    df = spark.createDataFrame([("x" * 5000, 1.0)], "s string, d double")
    plan = keys.key_counts(df, head=True)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and all("(col_idx" in e and "s#" not in e.split("ENSURE")[0] for e in exchanges)
    plan = profile.duplicate_rows(df)._jdf.queryExecution().executedPlan().toString()
    assert any("hashpartitioning(row#" in line or "hashpartitioning(knownfloatingpointnormalized" in line.lower() for line in plan.splitlines())


def test_row_digest_tells_rows_apart(spark):
    rows = [("a", "b"), ("ab", ""), ("", "ab"), (None, "ab"), ("ab", None), ("1:a", ""), ("", "1:a"), ("-", None), (None, "-"), (None, None)]
    df = spark.createDataFrame(rows, "x string, y string")
    assert df.select(keys.row_digest(df).alias("k")).distinct().count() == len(rows)
    same = spark.createDataFrame([(NAN, 0.0), (None, -0.0)], "x double, y double")
    assert same.select(keys.row_digest(same).alias("k")).distinct().count() == 1
    assert profile.duplicate_rows(_odd(spark)).first().asDict() == {"rows": 6, "distinct_rows": 5, "duplicate_rows": 1}
    assert profile.duplicate_rows(_odd(spark).limit(0)).first().rows == 0
    assert _odd(spark).select(F.col("s")).count() == 6


def _split(df, keys, ratio):
    from tessera.operators.sampling import exact_split_flag

    return exact_split_flag(df, keys, ratio, 42, "train")


def test_exact_split_is_the_first_hashes(spark):
    import hashlib
    import math

    for n, ratio in ((10, 0.8), (11, 0.8), (97, 0.75), (1000, 0.8), (3, 0.999), (5, 0.5)):
        df = spark.range(n).repartition(3)
        got = {r.id: r.train for r in _split(df, ["id"], ratio).collect()}
        order = sorted(range(n), key=lambda i: hashlib.md5(f"{i}:42".encode()).hexdigest())
        test = math.ceil(round(n * (1 - ratio), 9))
        assert {i for i, t in got.items() if not t} == set(order[:test])
        plan = _split(df, ["id"], ratio)._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in plan and "Sort" not in plan
    assert _split(spark.range(0), ["id"], 0.8).count() == 0


def test_exact_split_of_a_million_rows(spark):
    got = _split(spark.range(1_000_000), ["id"], 0.8).groupBy("train").count().collect()
    assert {r.train: r["count"] for r in got} == {True: 800_000, False: 200_000}


def test_exact_split_of_ties(spark):
    """One key for all rows, then copies of one row."""
    df = spark.range(100).selectExpr("1 AS k", "id AS v", "CAST('NaN' AS DOUBLE) AS x")
    got = _split(df, ["k"], 0.8).collect()
    assert sum(not r.train for r in got) == 20 and {r.v for r in got} == set(range(100))
    copies = spark.createDataFrame([(1, "a")] * 50 + [(2, "b")] * 3, "k int, s string")
    got = _split(copies, ["k"], 0.7).collect()
    assert len(got) == 53 and sum(not r.train for r in got) == 16 and sum(r.k == 2 for r in got) == 3


def test_numeric_sample_by_threshold(spark):
    """The first n present cells of each column in hash order, against a full sort."""
    from tessera.operators.sampling import numeric_sample, sample_key

    i = F.col("id")
    df = spark.range(5000).select(i, F.when(i % 50 == 0, i).cast("double").alias("rare"), F.lit(None).cast("int").alias("none"), (i % 7).alias("x"), F.lit("t").alias("t")).repartition(4)
    hashed = sorted((r.h, r.id, r.rare, r.x) for r in df.select(sample_key(["id"]).alias("h"), "id", "rare", "x").collect())
    for n in (1, 100, 6000):
        got = {}
        for r in numeric_sample(df, ["id"], n).orderBy("rank").collect():
            got.setdefault(r.column_name, []).append(r.value)
        want = {c: [float(v) for v in (h[j] for h in hashed) if v is not None][:n] for j, c in ((1, "id"), (2, "rare"), (3, "x"))}
        assert got == want
    assert numeric_sample(df.limit(0), ["id"]).count() == 0 and numeric_sample(df.select("none")).count() == 0
    assert numeric_sample(df, n=10).groupBy("column_name").count().where("count = 10").count() == 3
