"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct runs of 3 to 5 code points (lower-cased,
white space run together, a space at both ends), hashed to 2^18 slots and
present or not.  On labelled texts each slot gets r = log of the ratio of its
smoothed shares of the two classes' texts; a logistic regression is trained on
presence times r (Wang & Manning 2012), at unit length, by averaging the weights that
shards of 1,500 training rows learn (parameter mixing).  Its intercept is then
moved from the balance of the sample to that of all training labels.

The fit takes a bounded sample: of each class the rows with the smallest hash of
doc_id, at most ``per_class`` of them.  All texts are scored whole.

Defined cases: a null text is an empty one; an empty text scores what the
intercept says; labels that are null or belong to no document are not used, and
a doc_id with both labels counts as toxic; without training rows of both classes
every score is 1 if there are some of label 1, else 0; repeated
rows score alike; other columns are kept, those named ``score`` or ``predicted``
are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.rows import named, packed
from tessera.session import materialise

#: Code points in an n-gram, bits of a slot, rows of a class in the sample, rows of a shard, rounds of averaging, passes a round, smoothing.
GRAMS, BITS, PER_CLASS, SHARD_ROWS, ROUNDS, PASSES, ALPHA = (3, 4, 5), 18, 6000, 1500, 2, 4, 0.1
SPACE = re.compile(r"\s+")


def slots(text: str | None) -> np.ndarray:
    """The distinct slots of a text's n-grams."""
    points = np.frombuffer(f" {SPACE.sub(' ', (text or '').lower()).strip()} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    code, found = points, []
    for n in range(2, GRAMS[-1] + 1):
        code = code[:-1] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :] if len(points) >= n else code[:0]
        if n in GRAMS:
            mixed = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            found.append((mixed >> np.uint64(64 - BITS)).astype(np.int32))
    every = np.sort(np.concatenate(found))
    return every[np.diff(every, prepend=-1) > 0]


def scaled(ratios: np.ndarray) -> np.ndarray:
    """A text's feature vector: the ratios of the slots that are present, at length 1."""
    return ratios / np.sqrt(max(1.0, float(ratios @ ratios)))


@dataclass
class Model:
    ratio: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        found = slots(text)
        x = scaled(self.ratio[found])
        with np.errstate(over="ignore"):
            return float(1 / (1 + np.exp(-(self.bias + self.weights[found] @ x))))


def learn(features: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, weights: np.ndarray, bias: float, rate: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """A few passes of AdaGrad for the logistic loss over presence times ``ratio``, rows in the given order."""
    weights, sums, bias_sum = weights.copy(), np.full(len(weights), 1e-2), 1e-2
    for _ in range(PASSES):
        for f, y in zip(features, labels, strict=True):
            x = scaled(ratio[f])
            error = 1 / (1 + np.exp(-np.clip(bias + weights[f] @ x, -30, 30))) - y
            step = error * x + decay * weights[f]
            sums[f] += step**2
            weights[f] -= rate * step / np.sqrt(sums[f])
            bias_sum += error**2
            bias -= rate * error / np.sqrt(bias_sum)
    return weights, bias


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """From the texts (doc_id, text) and the labels (doc_id, toxic 0/1) to learn from, one row a document."""
    labels = materialise(labels.join(docs.select("doc_id").distinct(), "doc_id"), "toxicity-labels")
    counted = {r.toxic: r.n for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    ones, zeros = counted.get(1, 0), counted.get(0, 0)
    if not ones or not zeros:
        share = ones / max(1, ones + zeros)
        return Model(np.zeros(1 << BITS), np.zeros(1 << BITS), np.inf if share else -np.inf)
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = [labels.where(F.col("toxic") == y).orderBy(*order).limit(per_class) for y in (0, 1)]
    texts = docs.join(F.broadcast(chosen[0].union(chosen[1])), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("text").alias("text"))
    taken = [min(n, per_class) for n in (zeros, ones)]
    shards = -(-sum(taken) // SHARD_ROWS)
    sample = materialise(texts.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")), "toxicity-sample")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((2, 1 << BITS), np.int64)
        for part in batches:
            for text, y in zip(part["text"], part["toxic"], strict=True):
                seen[int(y)][slots(text)] += 1
        used = np.flatnonzero(seen.any(0))
        yield pd.DataFrame({"slot": used, "n0": seen[0][used], "n1": seen[1][used]})

    seen = sample.select("text", "toxic").mapInPandas(count, "slot long, n0 long, n1 long").groupBy("slot").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()  # 2^18 rows at most
    shares = np.full((2, 1 << BITS), ALPHA)
    shares[0][seen["slot"]] += seen["n0"]
    shares[1][seen["slot"]] += seen["n1"]
    ratio = np.log(shares[1] / (taken[1] + 2 * ALPHA)) - np.log(shares[0] / (taken[0] + 2 * ALPHA))
    used = np.sort(seen["slot"].to_numpy())
    spark = docs.sparkSession
    weights, bias = np.zeros(1 << BITS), 0.0
    for _ in range(ROUNDS):
        sent = spark.sparkContext.broadcast((ratio, weights, bias))

        def shard(part: pd.DataFrame) -> pd.DataFrame:
            ratio, weights, bias = sent.value
            part = part.sort_values("doc_id").sample(frac=1, random_state=0)
            weights, bias = learn([slots(t) for t in part["text"]], part["toxic"].to_numpy(float), ratio, weights, bias)
            return pd.DataFrame({"weights": [weights[used].astype("<f8").tobytes()], "bias": [bias]})

        learnt = sample.groupBy("shard").applyInPandas(shard, "weights binary, bias double").collect()  # a vector of 2^18 at most from each of the shards
        learnt.sort(key=lambda r: (r.bias, r.weights))
        weights = np.zeros(1 << BITS)
        weights[used] = np.mean([np.frombuffer(r.weights, "<f8") for r in learnt], 0)
        bias = float(np.mean([r.bias for r in learnt]))
    return Model(ratio, weights, bias + float(np.log(ones / zeros) - np.log(taken[1] / taken[0])))


def score(df: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """The columns of ``df`` plus score (0 to 1) and predicted (score >= 0.5)."""
    sent, added = df.sparkSession.sparkContext.broadcast(model), ("score", "predicted")
    source = df.select(packed(df, (text, *added)).alias("row"), named(text).alias("text"))
    schema = T.StructType([source.schema["row"], *[source.schema["text"]] * keep_text, T.StructField("score", T.DoubleType(), False), T.StructField("predicted", T.IntegerType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([sent.value.score(t.as_py()) for t in batch.column("text")], float)
            yield pa.RecordBatch.from_arrays([batch.column("row"), *[batch.column("text")] * keep_text, pa.array(scores), pa.array((scores >= 0.5).astype("int32"))], names=[f.name for f in schema])

    found = source.mapInArrow(run, schema)
    kept = [c for c in df.columns if c not in added and (keep_text or c != text)]
    return found.select(*[F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in kept], *added)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def fit_on_labels(spark, docs: DataFrame, sf_dir: str, per_class: int = PER_CLASS) -> Model:
    """A model from ``labels.toxic`` of those of ``docs`` that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    labels = labels.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return fit(docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text"), labels, per_class)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` scored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_on_labels(spark, docs, sf_dir)
    return score(docs.withColumn("held_out", held_out(F.col("doc_id"))), model, keep_text=False)
