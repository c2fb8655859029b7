import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import features, sampling


def brute(values):
    return {v: i for i, v in enumerate(sorted({"nan" if v is None else v for v in values}, key=lambda v: v.encode()))}


@pytest.fixture(scope="module")
def texts():
    """Texts of all lengths that begin alike in groups, with repeats, empty ones, nulls and code points of 1 to 4 bytes."""
    rng = random.Random(5)
    some = ["", "a", "ab", "nan", "é", "\U0001f600", "￿", "z" * 60, None]
    some += ["".join(rng.choice("abé퟿\U0001f600") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    some += ["x" * n for n in range(1, 70)] + ["p" * 30 + f"{rng.randrange(90):02d}" + "q" * rng.randrange(40) for _ in range(400)]
    return some + some[:80]


@pytest.mark.parametrize("chars, rows", [(48, 500), (2, 3), (1, 0)])
def test_codes_follow_the_whole_texts(spark, texts, monkeypatch, chars, rows):
    monkeypatch.setattr(features, "RANGE_CHARS", chars)
    monkeypatch.setattr(features, "RANGE_ROWS", rows)
    df = spark.createDataFrame([(t, str(i % 7)) for i, t in enumerate(texts)], "t string, u string").repartition(5)
    found = features.vocabularies(df, ["t", "u"])
    for c, values in (("t", texts), ("u", [str(i) for i in range(7)])):
        table, size, _, _ = found[c]
        want = brute(values)
        assert {r["value"]: r["code"] for r in table.collect()} == want and size == len(want)


def test_ranges_are_drawn_by_short_starts(spark, monkeypatch, capsys):
    """Spark samples the keys of a range exchange to the driver: no whole text is one."""
    seen = []
    index = sampling.dense_index
    monkeypatch.setattr(sampling, "dense_index", lambda df, name="idx": (seen.append(df), index(df, name))[1])
    df = spark.range(500).select(F.concat(F.sha2(F.col("id").cast("string"), 256), F.repeat(F.lit("long text "), 300)).alias("t"))
    features.vocabularies(df, ["t"])
    capsys.readouterr()
    seen[0].explain()
    keys = [line.split("rangepartitioning(")[1].split("ASC NULLS")[1] for line in capsys.readouterr().out.splitlines() if "rangepartitioning(" in line]
    assert keys and all("FIRST, value" not in k and k.startswith(" FIRST, ") for k in keys)


@pytest.mark.parametrize("n", [400, 5000])
def test_longer_starts_where_many_begin_alike(spark, monkeypatch, n):
    """A common beginning doesn't put all its texts into one range."""
    if n < 500:
        monkeypatch.setattr(features, "RANGE_ROWS", 50)
    same = F.repeat(F.lit("same "), 100)
    cells = spark.range(n).select(F.lit(0).alias("col_idx"), F.when(F.col("id") < 20, F.col("id").cast("string")).otherwise(F.concat(same, F.col("id").cast("string"))).alias("value"))
    starts = cells.select(features.range_key(cells).alias("start")).distinct().collect()
    assert len(starts) == n
