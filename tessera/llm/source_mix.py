"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Every document has a fixed 40-bit hash.  Sizes are summed by (source, top hash
bits); the bucket in which a source's budget runs out is refined by the next
bits until it is one hash value, and documents below that threshold are taken.
Nothing is sorted and no group is gathered: each level is one partial
aggregation of at most 1,024 buckets a source.

Defined cases: a null text has size 0; a null source is a source of its own,
ordered last; rows that repeat a doc_id (or have none) share a hash and are
taken or left together; an empty table gives an empty result; a source of size
0 has target 0.  :func:`mix` keeps all columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import materialise

#: Bits refined by each histogram, and the number of histograms: 40 bits in all.
BITS, LEVELS = 10, 4
#: A source table up to this many rows is broadcast (a few MB); a larger one is joined by shuffle.
BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    """Number of runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def position(doc_id: Column) -> Column:
    """The document's place in [0, 2^40): the first ten hex digits of the id's md5."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 10), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    """(source, skey, source_size) -> plus target: ``share`` of all sizes by weight, capped, excess reshared.

    Resharing until nobody is above its cap fills the sources in the order of
    cap / weight; a source is capped if its share of what the earlier ones left
    reaches its cap.  One row a source goes through the window.
    """
    everything = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    limit = F.col("source_size") * cap
    ranked = sizes.withColumn("w", weight).withColumn("limit", limit).withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
    upto = everything.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    onward = everything.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(0, Window.unboundedFollowing)
    left = F.col("total") - F.coalesce(F.sum("limit").over(upto), F.lit(0))
    capped = ranked.withColumn("capped", left / F.sum("w").over(onward) * F.col("w") >= F.col("limit"))
    rest = (F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("limit"))).over(everything), F.lit(0)))
    level = rest / F.sum(F.when(~F.col("capped"), F.col("w"))).over(everything)
    return capped.withColumn("target", F.when(F.col("capped"), F.col("limit").cast("double")).otherwise(level * F.col("w"))).select("source", "skey", "source_size", "target")


def thresholds(sized: DataFrame, plan: DataFrame, hint) -> DataFrame:
    """(skey, whole, threshold): copies of every document, and the hash below which one more is taken."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    at = plan.select("skey", whole.alias("whole"), (F.col("target") - whole * F.col("source_size")).alias("budget"),
                     F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("inside"))
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        inside = sized.join(hint(at.select("skey", "prefix")), "skey").where(F.shiftright("h", shift + BITS) == F.col("prefix"))
        bars = inside.groupBy("skey", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("bar"))
        run = Window.partitionBy("skey").orderBy("bucket")
        bars = bars.join(hint(at.select("skey", "whole", "budget", "below")), "skey")
        bars = bars.withColumn("upto", F.col("below") + F.sum("bar").over(run)).where(F.col("upto") >= F.col("budget"))
        at = bars.groupBy("skey").agg(F.min(F.struct("bucket", "bar", "upto", "whole", "budget")).alias("b")).select(
            "skey", "b.whole", "b.budget", F.col("b.bucket").alias("prefix"), (F.col("b.upto") - F.col("b.bar")).alias("below"), F.col("b.bar").alias("inside"))
    nearer = F.abs(F.col("below") + F.col("inside") - F.col("budget")) < F.abs(F.col("below") - F.col("budget"))
    return at.select("skey", "whole", (F.col("prefix") + nearer.cast("long")).alias("threshold"))


def source_key(source: Column) -> Column:
    """A key that is never null and tells null from every name."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def cuts(docs: DataFrame, weights: tuple[int, ...], share: float, cap: int):
    """The sized rows, one row per source (skey, source_size, target, whole, threshold), and its join hint.

    The texts are read once, to count their words; the histograms run over the
    written (doc_id, source, size, hash) rows.
    """
    sized = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), position(F.col("doc_id")).alias("h"), source_key(F.col("source")).alias("skey")), "mix-sizes")
    sizes = materialise(sized.groupBy("source", "skey").agg(F.sum("size").alias("source_size")), "mix-sources")
    few = sizes.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    hint = F.broadcast if few else (lambda df: df)
    plan = materialise(targets(sizes, weights, share, cap), "mix-targets")
    cut = thresholds(sized, plan, hint)
    return sized, materialise(plan.drop("source").join(cut, "skey", "left"), "mix-cuts"), hint


def copies(h: Column) -> Column:
    return F.coalesce(F.col("whole") + (h < F.col("threshold")).cast("long"), F.lit(0)).cast("long")


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies (0 to ``cap``), taken."""
    sized, cut, hint = cuts(docs, weights, share, cap)
    out = sized.join(hint(cut), "skey", "left").withColumn("copies", copies(F.col("h")))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2) -> DataFrame:
    """The mixed documents themselves: each as often as the mix takes it, with all its columns.

    Only the table of sources is joined, so no text is shuffled while it is small.
    """
    _, cut, hint = cuts(docs, weights, share, cap)
    names = docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), position(F.col("doc_id")).alias("h"), source_key(F.col("source")).alias("skey"))
    taken = keyed.join(hint(cut), "skey").withColumn("copies", copies(F.col("h"))).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op9_source_mix(spark, sf_dir: str) -> DataFrame:
    """The mix over the whole of ``documents`` (weights 3, 1, 2; 150 % of all sizes; at most twice)."""
    return plan_mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


#: The same mix in SQL: running sums in hash order instead of histograms.
OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 10) AS BIGINT) AS h
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS s FROM sized GROUP BY source),
ranked AS (
  SELECT source, s, 2 * s AS cap, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w,
         CAST(sum(s) OVER () AS BIGINT) * CAST(1.5 AS DOUBLE) AS total
  FROM sizes),
turn AS (
  SELECT *, (total - coalesce(CAST(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))
         / CAST(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) * w >= cap AS capped
  FROM ranked),
level AS (
  SELECT (max(total) - coalesce(CAST(sum(cap) FILTER (capped) AS BIGINT), 0)) / CAST(sum(w) FILTER (NOT capped) AS BIGINT) AS fill FROM turn),
plan AS (
  SELECT source, s, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE fill * w END AS target FROM turn, level),
budget AS (
  SELECT *, CASE WHEN s > 0 THEN CAST(floor(target / s) AS BIGINT) ELSE 0 END AS whole FROM plan),
bars AS (SELECT source, h, CAST(sum(size) AS BIGINT) AS bar FROM sized GROUP BY source, h),
run AS (
  SELECT source, h, bar, CAST(sum(bar) OVER (PARTITION BY source ORDER BY h) AS BIGINT) AS upto FROM bars),
cut AS (
  SELECT b.source, b.whole, b.s, b.target, min(r.h) AS h,
         arg_min(CASE WHEN abs(r.upto - (b.target - b.whole * b.s)) < abs(r.upto - r.bar - (b.target - b.whole * b.s)) THEN 1 ELSE 0 END, r.h) AS more
  FROM budget b JOIN run r ON r.source IS NOT DISTINCT FROM b.source AND r.upto >= b.target - b.whole * b.s
  GROUP BY ALL)
SELECT d.doc_id, d.size, c.s AS source_size, c.target, d.size * (c.whole + CASE WHEN d.h < c.h + c.more THEN 1 ELSE 0 END) AS taken
FROM sized d JOIN cut c ON c.source IS NOT DISTINCT FROM d.source
"""
