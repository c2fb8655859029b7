"""Near-duplicate documents by SuperMinHash signatures, banding and exact verification.

A document is the set of its distinct shingles (runs of ``width`` words, 64-bit
hashes).  Documents with the same set, told by a 128-bit digest, are one node.
A node's SuperMinHash signature (Ertl 2017) gives every shingle one random
permutation of the slots and keeps, slot by slot, the smallest permutation rank
plus fraction; ranks are handled one after the other for all shingles of a block
and a document stops as soon as each slot has a value, after a few ranks.  Its
32 bands of 6 slots put it into buckets.

Within a bucket no pairs are listed.  The members are verified against the
bucket's smallest id first (one verification a member, over all its buckets);
what that links is one component.  In buckets that still hold several components
the shingles that no other member of such buckets has are counted: with u of its n
shingles its own, a document differs from one of n' shingles in 2u + n' - n at
least; members that this rules out leave, exactly.  What remains is cut into blocks
of about 100,000 shingles; a task counts the shared shingles of two blocks of a
bucket by a product of their incidence matrices and returns links only, one a
member at most.  So every candidate pair is verified, ruled out or joined by other
links, and none is dropped: a pair at 0.8 shares no bucket with probability 6e-5,
one at 0.9 with less than 1e-10.  Links are confirmed on the full sets.

Defined cases: a null or empty text, or one without words, has an empty set and
is linked with nothing; a shorter text than ``width`` words has one shingle;
rows without a doc_id are linked with nothing, have no component and are kept;
rows that repeat a doc_id are one document, linked if any of its rows is; an
empty table gives an empty result; extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components, local_roots
from tessera.session import materialise

#: Words of a shingle, slots of a band, bands; similarity in percent; shingles sketched at a time, and in a block of a bucket.
WIDTH, ROWS, BANDS, PERCENT, BLOCK, PART = 4, 6, 32, 80, 1_000_000, 100_000
UNSET = np.uint64(2**64 - 1)
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that scatters them (splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


FACTORS = mixed(np.arange(1, 65, dtype=np.uint64)) | U(1)


class WordHashes(dict):
    """word -> 64-bit hash, remembered; emptied when large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: bytes | None, hashes: WordHashes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes; bytes.split() splits at just the six ASCII white spaces."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(width, len(codes))
    total = codes[: len(codes) - width + 1] * FACTORS[0]
    for i in range(1, width):
        total = total + codes[i : len(codes) - width + 1 + i] * FACTORS[i]
    found = np.sort(mixed(total + U(width)))
    return found[np.append(True, found[1:] != found[:-1])]


def signatures(sets: list[np.ndarray], slots: int = ROWS * BANDS) -> np.ndarray:
    """SuperMinHash of each non-empty set: rank in the top 8 bits, fraction below."""
    out = np.full(len(sets) * slots, UNSET)
    element = np.concatenate(sets)
    base = np.repeat(np.arange(len(sets)) * slots, [len(s) for s in sets])
    moved: list[tuple[np.ndarray, np.ndarray]] = []  # (position, what the swap put there) of each earlier rank
    table = None  # or the permutations themselves, once few elements are left
    for rank in range(slots):
        draw = mixed(element + U((2 * rank + 1) * 0x9E3779B97F4A7C15 % 2**64))
        at = rank + (mixed(draw) % U(slots - rank)).astype(np.int64)
        if table is None and len(element) <= 20_000:
            table = np.tile(np.arange(slots, dtype=np.int16), (len(element), 1))
            line = np.arange(len(element))
            for position, value in moved:
                table[line, position] = value
        if table is None:
            slot, front = at, np.full(len(at), rank)
            for position, value in moved:
                slot, front = np.where(position == at, value, slot), np.where(position == rank, value, front)
            moved.append((at, front))
        else:
            line = np.arange(len(element))
            slot = table[line, at].astype(np.int64)
            table[line, at] = table[:, rank]
        np.minimum.at(out, base + slot, (U(rank) << U(56)) | (draw >> U(8)))
        open_ = (out.reshape(-1, slots) == UNSET).any(1)
        if not open_.any():
            break
        more = open_[base // slots]
        if not more.all():
            element, base = element[more], base[more]
            moved = [(p[more], v[more]) for p, v in moved]
            table = None if table is None else table[more]
    return out.reshape(-1, slots)


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key a band, different from band to band."""
    slots = signature.reshape(len(signature), -1, rows)
    keys = np.broadcast_to(np.arange(1, slots.shape[1] + 1, dtype=np.uint64), slots.shape[:2])
    for i in range(rows):
        keys = mixed(keys * FACTORS[i] + slots[:, :, i])
    return keys


def sketch(docs: DataFrame, rows: int, bands: int) -> DataFrame:
    """(doc_id, n, d0, d1, bands): set size, digest of the set (null if empty), band keys."""
    names = ["doc_id", "n", "d0", "d1", "bands"]

    def emit(ids: list[int | None], sets: list[np.ndarray]) -> pa.RecordBatch:
        full = [i for i, s in enumerate(sets) if len(s)]
        keys = band_keys(signatures([sets[i] for i in full], rows * bands), rows).astype("<u8") if full else ()
        found, low, high = [None] * len(sets), [None] * len(sets), [None] * len(sets)
        for i, k in zip(full, keys, strict=True):
            low[i], high[i] = np.frombuffer(xxhash.xxh3_128_digest(sets[i].tobytes()), "<i8").tolist()
            found[i] = k.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ids, sets, size = WordHashes(), [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                ids.append(doc_id)
                sets.append(shingles(text.as_py(), hashes))
                size += len(sets[-1])
                if size >= BLOCK or len(ids) >= 5000:
                    yield emit(ids, sets)
                    ids, sets, size = [], [], 0
        if ids:
            yield emit(ids, sets)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, d0 long, d1 long, bands array<long>")


def full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, shingles): the sorted shingle hashes of the documents in ``nodes`` (id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = [shingles(t.as_py(), hashes).tobytes() for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.binary())], names=["id", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(nodes.select("id").distinct(), "id", "left_semi")
    return texts.mapInArrow(run, "id long, shingles binary").where(F.length("shingles") > 0)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            similar = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                similar.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(similar))

    x, y = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    near = F.least(F.length("x"), F.length("y")) * 100 >= F.greatest(F.length("x"), F.length("y")) * percent
    return pairs.join(x, "a").join(y, "b").where(near).select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def own_shingles(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, n, own): of the ``nodes`` (id), how many shingles of a set no other of them has; sets without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                found = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column("shingles")]
                sizes = np.array([len(x) for x in found])
                ids = np.repeat(part.column("id").to_numpy(), sizes)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate(found))], names=["id", "n", "shingle"])

    each = sets.join(nodes.select("id").distinct(), "id", "left_semi").mapInArrow(run, "id long, n long, shingle long")
    alone = each.groupBy("shingle").agg(F.min("id").alias("id"), F.max("id").alias("last"), F.min("n").alias("n")).where("id = last")
    return alone.groupBy("id", "n").agg(F.count("*").alias("own"))


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], columns: int = 20_000) -> np.ndarray:
    """Sizes of the intersections of all sets on the left with all on the right."""
    sizes = [np.array([len(s) for s in side]) for side in (left, right)]
    every, column = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    first, second = column[: sizes[0].sum()], column[sizes[0].sum() :]
    common = np.flatnonzero((np.bincount(first, minlength=len(every)) > 0) & (np.bincount(second, minlength=len(every)) > 0))
    place = np.full(len(every), -1)
    place[common] = np.arange(len(common))
    out = np.zeros((len(left), len(right)), np.int64)
    for start in range(0, len(common), columns):
        tables = []
        for side, found in zip(sizes, (first, second), strict=True):
            table = np.zeros((len(side), min(columns, len(common) - start)), np.float32)
            row, at = np.repeat(np.arange(len(side)), side), place[found] - start
            inside = (at >= 0) & (at < table.shape[1])
            table[row[inside], at[inside]] = 1
            tables.append(table)
        out += (tables[0] @ tables[1].T).astype(np.int64)  # exact below 2^24
    return out


def compared(members: DataFrame, part: int, percent: int) -> DataFrame:
    """(a, b): enough links between members (bucket, id, component, n, shingles) of a bucket to join what is similar."""
    blocks = members.groupBy("bucket").agg(F.ceil(F.sum("n") / part).cast("int").alias("blocks"))
    dealt = members.join(blocks, "bucket").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    packed = materialise(dealt.groupBy("bucket", "block").agg(F.collect_list(F.struct("id", "component", "shingles")).alias("sets")), "near-packed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = x.as_py(), y.as_py()
                left, right = ([np.frombuffer(s["shingles"], np.uint64) for s in side] for side in (x, y))
                ids, groups = ([np.array([s[name] for s in side]) for side in (x, y)] for name in ("id", "component"))
                sizes = [np.array([len(s) for s in side]) for side in (left, right)]
                shared = shared_counts(left, right)
                similar = 100 * shared >= percent * (sizes[0][:, None] + sizes[1][None, :] - shared)
                p, q = np.nonzero(similar & (groups[0][:, None] != groups[1][None, :]))
                both, place = np.unique(np.concatenate([ids[0][p], ids[1][q]]), return_inverse=True)
                roots = local_roots(len(both), place[: len(p)], place[len(p) :])
                a.append(both[roots])
                b.append(both)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], names=["a", "b"])

    x, y = packed.select("bucket", "block", F.col("sets").alias("x")), packed.select("bucket", F.col("block").alias("other"), F.col("sets").alias("y"))
    return x.join(y, "bucket").where("block <= other").select("x", "y").mapInArrow(run, "a long, b long").where("a < b").distinct()


def link(docs: DataFrame, buckets: DataFrame, percent: int, part: int) -> DataFrame:
    """(id, component) of all nodes that are linked, from the shared buckets (bucket, id, n: set size)."""
    sets = materialise(full_sets(docs, buckets), "near-sets")
    pivot = buckets.groupBy("bucket").agg(F.min("id").alias("pivot"))
    stars = buckets.join(pivot, "bucket").where("id > pivot").groupBy("id").agg(F.min("pivot").alias("a")).select("a", F.col("id").alias("b"))
    links = materialise(verified(stars, sets, percent), "near-links")
    found = materialise(components(links), "near-components")
    grouped = buckets.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    several = grouped.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.min("n").alias("smallest"))
    open_ = materialise(grouped.join(several.where("least < most").select("bucket", "smallest"), "bucket"), "near-buckets")
    counted = open_.join(own_shingles(sets, open_), ["id", "n"], "left").withColumn("own", F.coalesce("own", F.lit(0)))
    partner = F.greatest(F.col("smallest"), F.ceil(F.col("n") * percent / 100))
    possible = counted.where(F.col("own") * (100 + percent) <= F.col("n") * 100 - partner * percent)
    left = possible.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("bucket")
    members = possible.join(left, "bucket").select("bucket", "id", "component", "n").join(sets, "id")
    more = materialise(compared(members, part, percent), "near-links")
    return materialise(components(links.unionByName(more)), "near-components") if more.limit(1).count() else found


def near_duplicates(docs: DataFrame, percent: int = PERCENT, rows: int = ROWS, bands: int = BANDS, part: int = PART) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text)."""
    sketches = materialise(sketch(docs, rows, bands), "near-sketches")
    nodes = sketches.where("n > 0 and doc_id is not null").groupBy("d0", "d1").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = materialise(nodes, "near-nodes")
    every = nodes.select("id", "n", F.explode("bands").alias("bucket"))
    shared = every.groupBy("bucket").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("bucket")
    buckets = materialise(every.join(shared, "bucket").select("bucket", "id", "n"), "near-buckets")
    found = link(docs.where(F.col("doc_id").isNotNull()), buckets, percent, part)
    named = nodes.select("d0", "d1", "id").join(found, "id", "left").select("d0", "d1", F.coalesce("component", "id").alias("component"))
    out = sketches.drop("bands").join(named, ["d0", "d1"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op2_near_dup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of the whole of ``documents``: four words a shingle, similarity 0.8."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
