"""The corpus pipeline: filter, deduplicate, mix and tokenise ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``.  All stages but the last return
the columns of ``documents``.

Defined cases follow the operators': a null text is an empty one (and stays null),
rows without a doc_id are kept by the filters, near duplicates are told row by row
(an exact repeat within a near-duplicate group is kept once, another text under the
same doc_id is a document of its own), empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, chunk_dedup, near_dup, source_mix, toxicity
from tessera.llm.rows import packed, unpacked
from tessera.session import materialise

#: No stage can be written in SQL as a whole: the fitted classifier, chunking and merges have no SQL form.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = toxicity.fit_on_labels(spark, docs, sf_dir)
    found = toxicity.score(docs.select(packed(docs, ("text",)).alias("row"), "text"), model).where("predicted = 0")
    return found.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest doc_id stays; of its rows of that doc_id the smallest.

    A document is a doc_id with a text (a 64-bit hash of both is its id here), so a
    doc_id that comes with several texts is several documents.  What goes is joined
    by that hash; of the exact repeats of a row one stays.
    """
    row = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    named = docs.select(row.alias("id"), packed(docs).alias("row"))
    groups = near_dup.near_duplicates(docs.select(row.alias("doc_id"), "text"))
    groups = materialise(groups.where("doc_id is not null").select(F.col("doc_id").alias("id"), "component_id"), "pipeline-groups")
    linked = groups.groupBy("component_id").agg(F.count("*").alias("rows")).where("rows > 1").select("component_id")
    several = groups.distinct().join(linked, "component_id")
    ids = materialise(named.where(F.col("id").isNotNull()).join(several, "id"), "pipeline-linked")
    stays = ids.groupBy("component_id").agg(F.min("row").alias("row"))
    every = named.join(ids.select("id").distinct(), "id", "left_anti").select("row").unionByName(stays.select("row"))
    return every.select(*unpacked(every, docs))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document of smaller doc_id holds too are cut out; n_chars follows."""
    cut = chunk_dedup.dedup(docs)
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (not at all, once or twice)."""
    return source_mix.mix(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, token_ids; every text's ids are decoded, and the run fails unless that gives the text."""
    both = byte_bpe.encode(docs.select("doc_id", "lang", "source", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("original")), outputs=("token_ids", "decoded"))
    same = F.sha2("decoded", 256) == F.col("original")
    ids = F.when(same, F.col("token_ids")).otherwise(F.raise_error(F.lit("ids don't decode to the text")).cast("array<int>"))
    return both.select("doc_id", "lang", "source", ids.alias("token_ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("source_mix", mix_sources),
    ("byte_bpe", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
