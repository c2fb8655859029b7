"""Substring dedup by content-defined chunking with a gear rolling hash.

A text's UTF-8 bytes are cut where the gear hash of the last 16 bytes has three
zero bits, at least 4 bytes after the last cut and at most 256, so cuts move
with the content and an insertion changes the chunks around it only.  What is
compared are windows: from every cut the shortest run of whole chunks with
``min_run`` bytes at least, and the last such run of the text.  The document
with the smallest doc_id that holds a window owns it; in every other document
the union of the windows that others own is cut out, so a repeated passage goes
from its first to its last common cut, and nothing below ``min_run`` bytes that
texts share by chance does.  A cut keeps whole words.

A document whose whole text one of smaller id holds loses all its windows, which its
text's digest tells; it sends none.  Of the others, only text that is repeated somewhere sends its windows.  It is found by anchors:
of every ``min_run`` bytes the smallest 40-bit gear hash of 32 of them (some two
in 65 bytes).  Equal windows have equal anchors, so none is missed; a hash that
two texts share by chance costs a few rows.  One row a distinct anchor or window
and document is shuffled, windows with a 128-bit digest; what all documents
share is reduced by partial aggregation, and its rows meet their owner in a join
that Spark can split, never in one group.

Defined cases: a null or empty text has no chunks and stays; rows without a
doc_id take no part and come back unchanged; rows that repeat a doc_id are one
document, and a document's own repeats stay; an empty table gives an empty
result; other columns are kept, those named like an added one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.near_dup import mixed
from tessera.llm.packing import sliced
from tessera.llm.rows import packed
from tessera.session import materialise

#: Bytes: shortest and longest chunk, shortest run that is cut out.  Zero bits at a cut.
SHORTEST, LONGEST, MIN_RUN, CUT_BITS = 4, 256, 96, 3
#: Bytes of a chunk above which its words are chunks; bits of an anchor.
SPARSE, ANCHOR_BITS = 64, 40
#: In place of a copy's anchors; bytes of text taken at a time (bounds memory only).
COPY, SLICE_BYTES = -1, 4_000_000
GEAR = np.random.default_rng(20_250_101).integers(0, 1 << 16, 256, dtype=np.uint16)
ANCHOR_GEAR = np.random.default_rng(20_250_102).integers(0, 1 << 64, 256, dtype=np.uint64)
SPACES = b" \t\n\v\f\r"


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``, never inside a code point."""
    raw = np.frombuffer(data, np.uint8)
    h = GEAR[raw]
    for step in (1, 2, 4, 8):  # h[i]: sum of the gear of byte i-k, shifted left by k, over the last 16 bytes
        h[step:] += h[:-step] << np.uint16(step)
    wanted = np.flatnonzero(h < 1 << (16 - CUT_BITS)) + 1
    ends, last, size = [], 0, len(data)
    for end in [*wanted.tolist(), size]:
        while end - last > LONGEST:
            last += LONGEST
            while data[last] & 0xC0 == 0x80:
                last -= 1
            ends.append(last)
        if end < size and (end - last < SHORTEST or data[end] & 0xC0 == 0x80):
            continue
        if end > last:
            ends.append(end)
            last = end
    return ends


def windows(data: bytes, min_run: int = MIN_RUN) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops, in bytes: the shortest run of chunks with ``min_run`` bytes at least from every cut, and the last one of the text.

    In a chunk of over ``SPARSE`` bytes (one word over and over may have no cut) the words are chunks.
    """
    ends = [0, *cuts(data)]
    inner = [i for a, b in zip(ends, ends[1:], strict=False) if b - a > SPARSE for i in range(a + 1, b) if data[i - 1] in SPACES]
    at = np.array(sorted([*ends, *inner]))
    stop = np.searchsorted(at, at + min_run)
    found = [(at[:-1][stop[:-1] < len(at)], at[stop[stop < len(at)]])]
    if len(data) >= min_run:
        found.append((at[[np.searchsorted(at, len(data) - min_run, side="right") - 1]], at[-1:]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def digests(data: bytes, min_run: int = MIN_RUN) -> tuple[list[tuple[int, int]], list[bytes]]:
    """The windows and their 128-bit digests."""
    found = list(zip(*(x.tolist() for x in windows(data, min_run)), strict=True))
    return found, [xxhash.xxh3_128_digest(data[a:b]) for a, b in found]


def anchors(data: bytes, min_run: int = MIN_RUN) -> np.ndarray:
    """For each run of ``min_run`` bytes, by its first one, the smallest hash of 32 bytes in it (fewer for a short run)."""
    width = 1
    while width < 32 and 4 * width <= min_run:
        width *= 2
    least = ANCHOR_GEAR[np.frombuffer(data, np.uint8)]
    step = 1
    while step < width:
        least[step:] += least[:-step] << np.uint64(step)
        step *= 2
    least, reach, wanted = mixed(least[width - 1 :]), 1, min_run - width + 1
    while reach < wanted and len(least):
        step = min(reach, wanted - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    return (least >> np.uint64(64 - ANCHOR_BITS)).view(np.int64)


def distinct(values: np.ndarray) -> np.ndarray:
    return np.unique(values[np.append(True, values[1:] != values[:-1])]) if len(values) else values


def copies(docs: DataFrame) -> DataFrame:
    """The doc_id of each document all of whose texts a document of smaller id holds as a whole.

    Every window of such a document is another's, so it needs neither anchors nor windows to tell.
    """
    texts = held(docs).select("doc_id", F.unhex(F.substring(F.sha2("text", 256), 1, 32)).alias("digest"))
    several = texts.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    found = texts.join(several, "digest", "left").groupBy("doc_id").agg(F.bool_and(F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))).alias("copy"))
    return found.where("copy").select("doc_id")


def held(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull() & (F.length("text") > 0)).select("doc_id", "text")


def shared_anchors(docs: DataFrame, copied: DataFrame, min_run: int) -> DataFrame:
    """(doc_id, anchors): the anchors of a document that others hold too; ``COPY`` alone for the copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for start in range(0, len(ids), 500):
                found = [distinct(anchors(t.as_buffer().to_pybytes(), min_run)) for t in batch.column("text").cast(pa.binary())[start : start + 500]]
                repeated = np.repeat(ids[start : start + 500], [len(x) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(repeated), pa.array(np.concatenate(found))], names=["doc_id", "anchor"])

    every = held(docs).mapInArrow(run, "doc_id long, anchor long")
    shared = every.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")  # once a row of docs; rows of one doc_id cost a little
    both = every.join(shared, "anchor").select("doc_id", "anchor").unionByName(copied.select("doc_id", F.lit(COPY).cast("long").alias("anchor")))
    found = both.groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors"))
    return found.select("doc_id", F.when(F.array_contains("anchors", F.lit(COPY).cast("long")), F.array(F.lit(COPY).cast("long"))).otherwise(F.col("anchors")).alias("anchors"))


def beside(docs: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """``docs`` (doc_id, text, row) with ``name`` of ``found`` (doc_id, name), null for a document that has none.

    One plan for both uses, so that the texts are shuffled once.
    """
    return docs.join(found.select("doc_id", name), "doc_id", "left")


def shared_windows(docs: DataFrame, copied: DataFrame, min_run: int) -> DataFrame:
    """(doc_id, d0, d1): the windows of each document that others may hold too, but for copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            whole = whole.filter(whole.column("anchors").is_valid())
            for batch in sliced(whole, SLICE_BYTES):
                ids, keys = [], []
                for doc_id, text, shared in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), batch.column("anchors"), strict=True):
                    found = shared.values.to_numpy()
                    if found[0] == COPY:
                        continue
                    data = text.as_py() or b""
                    maybe = np.isin(anchors(data, min_run), found)
                    start, stop = windows(data, min_run)
                    chosen = maybe[start] & maybe[stop - min_run]
                    own = {xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(start[chosen].tolist(), stop[chosen].tolist(), strict=True)}
                    ids.append(np.full(len(own), doc_id, np.int64))
                    keys.extend(own)
                both = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *ids])), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["doc_id", "d0", "d1"])

    return beside(docs, shared_anchors(docs, copied, min_run), "anchors").mapInArrow(run, "doc_id long, d0 long, d1 long")


def foreign_windows(docs: DataFrame, copied: DataFrame, min_run: int) -> DataFrame:
    """(doc_id, foreign): the digests of a document's windows that a document of smaller id owns, 16 bytes each; one null for a copy."""
    every = shared_windows(docs, copied, min_run)
    owned = every.groupBy("d0", "d1").agg(F.min("doc_id").alias("owner"), F.count("*").alias("n")).where("n > 1").drop("n")
    found = every.join(owned, ["d0", "d1"]).where("doc_id > owner").groupBy("doc_id").agg(F.collect_list(F.struct("d0", "d1")).alias("foreign"))
    whole = F.array(F.lit(None).cast(found.schema["foreign"].dataType.elementType))
    return found.unionByName(copied.select("doc_id", whole.alias("foreign")))


class Everything:
    """The windows of others, to a copy."""

    def __contains__(self, digest: bytes) -> bool:
        return True


def runs(data: bytes, foreign: set[bytes] | Everything, min_run: int) -> list[tuple[int, int]]:
    """Byte ranges to cut out: the union of the foreign windows, shrunk to whole words."""
    joined: list[list[int]] = []
    for (start, stop), digest in zip(*digests(data, min_run), strict=True):
        if digest in foreign:
            if joined and start <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], stop)
            else:
                joined.append([start, stop])
    out = []
    for start, stop in joined:
        while 0 < start < stop and data[start - 1] not in SPACES and data[start] not in SPACES:
            start += 1
        while start < stop < len(data) and data[stop - 1] not in SPACES and data[stop] not in SPACES:
            stop -= 1
        if start < stop:
            out.append((start, stop))
    return out


def dedup(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """The columns of ``docs`` with the remaining ``text``, plus ``spans`` (what was cut out, as
    code points of the old text) and ``n_removed`` (code points)."""
    added = {"spans": T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])), "n_removed": T.LongType()}
    names = [c for c in docs.columns if c not in added]
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", packed(docs, ("text", *added)).alias("row"))
    schema = T.StructType([source.schema["row"], source.schema["text"], *[T.StructField(n, t) for n, t in added.items()]])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, SLICE_BYTES):
                texts, spans, removed = batch.column("text").to_pylist(), [], []
                for i, foreign in enumerate(batch.column("foreign")):
                    spans.append([])
                    if foreign.is_valid and texts[i]:
                        if foreign.values.null_count:
                            others = Everything()
                        else:
                            pairs = foreign.values.flatten()
                            keys = np.stack([p.to_numpy() for p in pairs], 1).astype("<i8").tobytes()
                            others = {keys[k : k + 16] for k in range(0, len(keys), 16)}
                        data = texts[i].encode()
                        pieces, last = [], 0
                        for start, stop in runs(data, others, min_run):
                            pieces.append(data[last:start])
                            first = len(data[:start].decode())
                            spans[-1].append({"start": first, "stop": first + len(data[start:stop].decode())})
                            last = stop
                        texts[i] = (b"".join(pieces) + data[last:]).decode()
                    removed.append(sum(s["stop"] - s["start"] for s in spans[-1]))
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), pa.array(spans, kind), pa.array(removed, pa.int64())], names=[f.name for f in schema])

    found = beside(source, foreign_windows(source, materialise(copies(source), "chunk-copies"), min_run), "foreign").mapInArrow(run, schema)
    return found.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in names], *added)


def op8_chunk_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` without the passages that documents of smaller id hold too."""
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
