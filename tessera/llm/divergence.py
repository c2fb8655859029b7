"""Source divergence audit with count-level bitmaps.

For every language, each source's smoothed term distribution is set against every
other source's and against the whole language's.  A term's share in a group depends
only on its count there, so a pair of groups needs no pass over terms: it needs the
number of terms with count i in one and count j in the other.

* A task counts terms by (language, source) in blocks of texts; Spark sums them.
* Kept terms are dealt into chunks of terms of like frequency, some ``CHUNK`` terms
  each, and numbered within their chunk.  A chunk keeps a bitset of term numbers for each
  (source, count); AND and popcount of two bitsets give a joint cell, which is
  multiplied by the divergence of its two counts.  Cells with count 0 follow
  by complement, so absent terms cost nothing.  Frequent terms have many count levels but
  are few; rare terms are many but have few levels.
* Sums over chunks are the divergences of pairs; a chunk's 200 best terms of a source
  compete for the source's report.

All arithmetic is on integers.  A chunk's table holds a row a term and one with the
sources of its language; more than ``BLOCK`` sources are dealt into blocks, and a
chunk is worked on once for each pair of blocks.  Nothing is broadcast by this module.

Defined cases: a null text, language or source is the empty one; repeated rows are
documents of their own; a group without kept terms has the smoothed shares of count 0;
a language without kept terms has divergence 0 for all its pairs; a single source has
no pairs; an empty table gives an empty result; other columns are ignored.  A sum
beyond a long raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import materialise

#: Documents of a language that hold a kept term; scale of a share; terms reported for a source.
MIN_DOCS, SCALE, REPORTED = 3, 1_000_000_000, 200
#: Terms of a chunk, sources of a block, words of memory for one AND, bytes of text counted at a time.
CHUNK, BLOCK, AND_WORDS, TEXT_BYTES = 4096, 256, 2_000_000, 16_000_000


# ----------------------------------------------------------------------------- counts
def term_bytes() -> np.ndarray:
    """Byte of a text -> byte by which terms are split: A-Z lower-cased, letters and bytes from 0x80 on as they are, else a space."""
    table = np.full(256, 32, np.uint8)
    for first, last in ((0x61, 0x7A), (0x80, 0xFF)):
        table[first : last + 1] = np.arange(first, last + 1)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    return table


def terms(texts: pa.StringArray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(number of each term in turn, the distinct terms, the text that each is in)."""
    _, ends, raw = texts.buffers()
    ends = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    plain = term_bytes()[np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]]] if raw is not None else np.zeros(0, np.uint8)
    split = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer((ends - ends[0]).astype(np.int32)), pa.py_buffer(plain)]))
    many = np.diff(split.offsets.to_numpy())
    words, inside = split.flatten(), np.repeat(np.arange(len(texts)), many)
    there = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    coded = words.filter(pa.array(there)).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary, inside[there]


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents; a null term for each group that occurs."""
    blank = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm.packing import sliced

        for whole in batches:
            for batch in sliced(whole, TEXT_BYTES):
                keys = pa.StructArray.from_arrays([batch.column("lang"), batch.column("source")], names=["lang", "source"]).to_pylist()
                groups = {k: i for i, k in enumerate(dict.fromkeys((k["lang"], k["source"]) for k in keys))}
                of = np.array([groups[k["lang"], k["source"]] for k in keys], np.int64)
                term, words, text = terms(batch.column("text"))
                size = max(1, len(words))
                pair, n = np.unique(text * size + term, return_counts=True)
                key, at = np.unique(of[pair // size] * size + pair % size, return_inverse=True)
                total, docs = np.bincount(at, n, len(key)).astype(np.int64), np.bincount(at, minlength=len(key))
                langs, sources = (pa.array([k[i] for k in groups], pa.string()) for i in (0, 1))
                group = pa.array(np.concatenate([key // size, np.arange(len(groups))]))
                zero = np.zeros(len(groups), np.int64)
                found = pa.concat_arrays([words.take(pa.array(key % size)), pa.nulls(len(groups), pa.string())])
                yield pa.RecordBatch.from_arrays([langs.take(group), sources.take(group), found, pa.array(np.concatenate([total, zero])), pa.array(np.concatenate([docs, zero]))], names=["lang", "source", "term", "n", "docs"])

    counted = docs.select(blank).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


# ----------------------------------------------------------------------------- chunks
OUT = "lang string, source string, part string, item string, value long"


def share(count: int, total: int, kept: int) -> int:
    return 1 + SCALE * (count + 1) // (total + kept)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q) for shares up to 10^9 + 1, which fits a long."""
    return (p - q) ** 2 // q


def levels(term: np.ndarray, source: np.ndarray, count: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(source, count, bitset of the terms with that count) of each level, by source."""
    order = np.lexsort((count, source))
    fresh = np.flatnonzero(np.diff(source[order], prepend=-1) | np.diff(count[order], prepend=-1))
    level = np.empty(len(order), np.int64)
    level[order] = np.repeat(np.arange(len(fresh)), np.diff(np.append(fresh, len(order))))
    bits = np.zeros((len(fresh), -(-n_terms // 64)), np.uint64)
    np.bitwise_or.at(bits, (level, term >> 6), np.uint64(1) << (term & 63).astype(np.uint64))
    return source[order][fresh], count[order][fresh], bits


def pair_sums(source: np.ndarray, p: np.ndarray, bits: np.ndarray, p0: np.ndarray, n_terms: int) -> np.ndarray:
    """[a, b]: sum over a chunk's terms of divergence(share in a, share in b), from the levels of all sources (sorted by source)."""
    n = len(p0)
    first = np.searchsorted(source, np.arange(n))
    has = np.flatnonzero(np.diff(np.append(first, len(source))))  # sources with a level
    per = lambda x, axis: np.add.reduceat(x, first[has], axis=axis) if len(has) else x
    size = np.bitwise_count(bits).sum(1, dtype=np.int64)
    out, joint, met = np.zeros((n, n), np.int64), np.zeros((n, n), np.int64), np.zeros((n, len(source)), np.int64)
    rows = max(1, AND_WORDS // max(1, bits.size))
    for start in range(0, len(source), rows):
        part = slice(start, start + rows)
        cells = np.bitwise_count(bits[part, None] & bits[None]).sum(2, dtype=np.int64)
        worth = per(cells * divergence(p[part, None], p[None]), 1)  # [level of a, source b]
        inside = per(cells, 1)
        rest = np.repeat(size[part, None], n, 1)
        rest[:, has] -= inside
        zero = rest * divergence(p[part, None], p0[None])
        zero[:, has] += worth
        np.add.at(out, source[part], zero)
        seen = np.zeros((len(inside), n), np.int64)
        seen[:, has] = inside
        np.add.at(joint, source[part], seen)
        np.add.at(met, source[part], cells)
    lower = (size[None] - met) * divergence(p0[:, None], p[None])  # a has none of the term, b has
    if len(has):
        out[:, has] += per(lower, 1)
    whole = np.zeros(n, np.int64)
    np.add.at(whole, source, size)
    return out + (n_terms - whole[:, None] - whole[None] + joint) * divergence(p0[:, None], p0[None])


def audit_chunk(key: tuple, table: pa.Table) -> pa.Table:
    """One chunk and pair of blocks: what it adds to its pairs, and the best terms of its sources."""
    lang, first, second = key[0].as_py(), key[3].as_py(), key[4].as_py()
    about = table.filter(pc.is_null(table["term"])).to_pylist()[0]
    names = [c["source"] for c in about["cells"]]
    totals, block, kept, n_terms = [c["n"] for c in about["cells"]], about["blocks"], about["kept"], about["n_terms"]
    place = {s: i for i, s in enumerate(names)}
    rows = table.filter(pc.is_valid(table["term"])).combine_chunks()
    cells = rows["cells"].combine_chunks()
    flat = cells.flatten()
    at = np.repeat(np.arange(len(rows)), pc.list_value_length(cells).to_numpy())
    coded = flat.field("source").dictionary_encode()
    source = np.array([place[s] for s in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
    count = flat.field("n").to_numpy()
    own, number, bits = levels(at, source, count, n_terms)
    p = np.array([share(c, totals[s], kept) for s, c in zip(own.tolist(), number.tolist(), strict=True)], np.int64)
    p0 = np.array([share(0, t, kept) for t in totals], np.int64)
    out: dict[str, list] = {"source": [], "part": [], "item": [], "value": []}
    sums = pair_sums(own, p, bits, p0, n_terms)
    for a, b in zip(*np.nonzero(~np.eye(len(names), dtype=bool)), strict=True):
        if {block[a], block[b]} == {first, second}:
            for c, v in (("source", names[a]), ("part", "pair"), ("item", names[b]), ("value", int(sums[a, b]))):
                out[c].append(v)
    if first == second:
        words, lang_total = rows["term"].to_pylist(), about["total"]
        q = np.array([share(t, lang_total, kept) for t in rows["total"].to_pylist()], np.int64)[at]
        ps = np.array([share(c, totals[s], kept) for s, c in zip(source.tolist(), count.tolist(), strict=True)], np.int64)
        value = divergence(ps, q)
        rank = np.empty(len(words), np.int64)
        rank[sorted(range(len(words)), key=lambda i: words[i].encode())] = np.arange(len(words))
        order = np.lexsort((rank[at], -value, source))
        order = order[(ps > q)[order]]
        nth = np.arange(len(order)) - np.searchsorted(source[order], source[order])
        for i in order[nth < REPORTED].tolist():
            for c, v in (("source", names[source[i]]), ("part", "term"), ("item", words[at[i]]), ("value", int(value[i]))):
                out[c].append(v)
    return pa.table({"lang": pa.array([lang] * len(out["value"]), pa.string()), **{c: pa.array(v, pa.int64() if c == "value" else pa.string()) for c, v in out.items()}})


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank; see the module."""
    counted = materialise(count_terms(docs), "divergence-counts")
    present = counted.where("term is null").select("lang", "source")
    by_term = counted.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("cells"))
    bucket = F.floor(2 * F.log2("total")).alias("bucket")
    kept = materialise(by_term.where(F.col("docs") >= MIN_DOCS).select("lang", "term", "total", "cells", bucket), "divergence-kept")
    sizes = kept.groupBy("lang", "bucket").agg(F.count("*").alias("n"), F.sum("total").alias("occurrences"))
    by_lang = sizes.groupBy("lang").agg(F.sum("n").alias("kept"), F.sum("occurrences").alias("total"))
    totals = kept.select("lang", F.explode("cells").alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("n"))
    groups = materialise(present.join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n")), "divergence-groups")
    n_blocks = F.ceil(F.count("*") / BLOCK).cast("int").alias("n_blocks")
    langs = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("sources"), n_blocks)  # a row a source
    langs = materialise(langs.join(by_lang, "lang", "left"), "divergence-langs")

    def block_of(source: Column) -> Column:
        return F.pmod(F.xxhash64(source), F.col("n_blocks")).cast("int")

    dealt = kept.join(sizes.select("lang", "bucket", F.ceil(F.col("n") / CHUNK).alias("parts")), ["lang", "bucket"])
    dealt = materialise(dealt.withColumn("part", F.pmod(F.xxhash64("term"), F.col("parts"))).drop("parts"), "divergence-chunks")
    chunks = dealt.groupBy("lang", "bucket", "part").agg(F.count("*").alias("n_terms"))
    key = ["lang", "bucket", "part", "first", "second"]
    both = [F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("first")]
    rows = dealt.join(langs.select("lang", "n_blocks"), "lang").select("*", *both).select("*", F.explode(F.sequence(F.col("first"), F.col("n_blocks") - 1)).alias("second"))
    mine = lambda c: block_of(c["source"]).isin(F.col("first"), F.col("second"))
    rows = rows.withColumn("cells", F.filter("cells", mine)).where(F.size("cells") > 0).select(*key, "term", "total", "cells")
    heads = chunks.join(langs, "lang").select("*", *both).select("*", F.explode(F.sequence(F.col("first"), F.col("n_blocks") - 1)).alias("second"))
    heads = heads.withColumn("cells", F.filter("sources", mine)).withColumn("blocks", F.transform("cells", lambda c: block_of(c["source"])))
    heads = heads.select(*key, "total", "cells", "blocks", "kept", "n_terms")
    found = rows.unionByName(heads, allowMissingColumns=True).groupBy(*key).applyInArrow(audit_chunk, OUT)
    found = materialise(found, "divergence-found")
    alone = groups.join(langs.where("kept is null").select("lang"), "lang")  # no kept term: all pairs differ by 0
    none = alone.join(alone.select("lang", F.col("source").alias("item")), "lang").where("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).unionByName(none)
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(best))
    return ranked.unionByName(found.where("part = 'term'").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= REPORTED))


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    """Every source of ``documents`` against the others of its language, and its most over-represented terms."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT doc) AS docs FROM w GROUP BY lang, source, term),
k AS (SELECT lang, term, sum(n) AS total FROM c GROUP BY lang, term HAVING sum(docs) >= 3),
v AS (SELECT lang, count(*) AS kept, sum(total) AS total FROM k GROUP BY lang),
held AS (SELECT c.lang, c.source, c.term, c.n FROM c JOIN k ON c.lang = k.lang AND c.term = k.term),
groups AS (
  SELECT g.lang, g.source, coalesce(sum(h.n), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source GROUP BY g.lang, g.source),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n,
    1 + (CAST(1000000000 AS HUGEINT) * (coalesce(h.n, 0) + 1)) // (g.total + v.kept) AS p,
    1 + (CAST(1000000000 AS HUGEINT) * (k.total + 1)) // (v.total + v.kept) AS q
  FROM groups g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang
  LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
