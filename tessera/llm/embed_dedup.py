"""Embedding near-dedup with product quantisation: inverted lists, table lookups, exact rerank.

Equal vectors of a label are one node.  A bounded sample fits the coarse centroids
and the codebooks of the residuals' subspaces; then every node is assigned to its
nearest centroid and coded, and the angle between it and its decoded form is kept.
A node probes every list that can hold a vector within the distance that the cosine
allows: the lists whose half-space against its own centroid is near enough.  Within
a list the angle to each decoded vector, less that vector's own angle to its decoded
form, is a lower bound, so pairs beyond the cosine are passed over without loss, and
the others are ranked by their exact cosine in double precision.  The recall is
therefore 1 by construction (the tests measure it).

Vectors cross one exchange, sorted by label, list and a checksum, and lie in the
shared folder as blocks of about 2,048, in the table's own width.  Blocks meet by a
product of their files, each pair once and only where labels and probed lists overlap,
so no vector is copied for the lists it probes; what is written does not grow with the
number of lists.  A pair of blocks returns one row for each vector that has a link: how
many, and the smallest id of its component within the two blocks.  That keeps all
counts and components without listing pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components, and rows without a label, link with nothing; so do vectors of another
length than each other; rows that repeat a vec_id are one vector if vector and label
agree, else they share an id (their links add up); rows without a vec_id link with
nothing, have no component and are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.components import components, local_roots
from tessera.llm.topk import usable
from tessera.session import materialise

#: Vectors in the fitting sample, to a list and a block; lists at most; subspaces, codes of each.
SAMPLE, LIST, BLOCK, LISTS, PARTS, CODES = 8192, 4096, 2048, 1024, 8, 32
#: Bytes of vectors to a file of blocks; files at most of a small table; rows multiplied at once; bytes of blocks kept in a task; share of probes from which lists are not told apart.
FILE, FILES, TILE, HELD, MOST = 16 << 20, 32, 256, 64 << 20, 0.5


def k_means(points: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    centres = points[np.random.default_rng(0).permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        nearest = distances(points, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        n = np.bincount(nearest, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` to all of ``y``."""
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ y.T + (y**2).sum(1)[None, :], 0)


@dataclass
class Index:
    centres: np.ndarray
    books: list[np.ndarray]  # of each subspace
    cuts: list[int]  # where the subspaces begin and end

    @cached_property
    def gaps(self) -> np.ndarray:
        """Distances of the centroids."""
        return np.sqrt(distances(self.centres, self.centres))

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """The list of each vector: the first of the nearest, so that equal vectors share it however they are batched."""
        out = np.zeros(len(unit), np.int32)
        for i in range(0, len(unit), 1024):
            d = distances(unit[i : i + 1024], self.centres)
            out[i : i + 1024] = (d <= d.min(1, keepdims=True) + 1e-9).argmax(1)
        return out

    def code(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and error (the angle to the decoded form) of each vector."""
        cell = self.cells(unit)
        rest = unit - self.centres[cell]
        codes = np.stack([distances(rest[:, a:b], book).argmin(1) for a, b, book in zip(self.cuts, self.cuts[1:], self.books, strict=False)], 1).astype(np.uint8)
        return cell, codes, self.angles(unit, self.decode(cell, codes)) + 1e-7

    def decode(self, cell: np.ndarray | int, codes: np.ndarray) -> np.ndarray:
        """Vectors by table lookup."""
        out = np.array(np.broadcast_to(self.centres[cell], (len(codes), self.centres.shape[1])))
        for i, (a, b, book) in enumerate(zip(self.cuts, self.cuts[1:], self.books, strict=False)):
            out[:, a:b] += book[codes[:, i]]
        return out

    @staticmethod
    def angles(unit: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Between each unit vector and the other of its place; half a turn to a zero vector, so that it bounds nothing."""
        length = np.sqrt((other**2).sum(1))
        return np.where(length > 0, np.arccos(np.clip((unit * other).sum(1) / np.maximum(length, 1e-300), -1, 1)), np.pi)

    def probes(self, unit: np.ndarray, cell: np.ndarray, reach: float, lists: np.ndarray | None = None) -> np.ndarray:
        """Whether each vector probes each list: the distance to the half-space nearer to that list's centroid is within reach."""
        lists = np.arange(len(self.centres)) if lists is None else lists
        own = ((unit - self.centres[cell]) ** 2).sum(1)
        return (distances(unit, self.centres[lists]) - own[:, None] <= 2 * reach * self.gaps[cell][:, lists] + 1e-8) | (lists[None, :] == cell[:, None])

    def lower_bounds(self, unit: np.ndarray, cell: int, codes: np.ndarray, error: np.ndarray) -> np.ndarray:
        """At most the distance of each vector to each coded one of a list."""
        decoded = self.decode(cell, codes)
        length = np.maximum(np.sqrt((decoded**2).sum(1)), 1e-300)
        angle = np.arccos(np.clip(unit @ decoded.T / length, -1, 1)) - error[None, :]
        return 2 * np.sin(np.maximum(angle, 0) / 2)

    def least(self, decoded: np.ndarray, error: np.ndarray, cosine: float) -> np.ndarray:
        """The product with a decoded vector below which :meth:`lower_bounds` rules a unit vector out."""
        angle = math.acos(max(-1.0, min(1.0, cosine))) + 1e-6 + error
        return np.where(angle < np.pi, np.sqrt((decoded**2).sum(1)) * np.cos(np.minimum(angle, np.pi)), -np.inf)


def fit(sample: np.ndarray, n: int) -> Index:
    """From unit vectors; as many lists as ``n`` vectors need."""
    dim = sample.shape[1]
    cuts = sorted({round(i * dim / PARTS) for i in range(PARTS + 1)})
    centres = k_means(sample, min(len(sample), max(1, min(LISTS, n // LIST))))
    rest = sample - centres[distances(sample, centres).argmin(1)]
    return Index(centres, [k_means(rest[:, a:b], min(CODES, len(rest))) for a, b in zip(cuts, cuts[1:], strict=False)], cuts)


def unit(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 1))
    x = x / np.abs(x).max(1, keepdims=True)  # so squares neither overflow nor vanish
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def runs(*keys: np.ndarray) -> list[tuple[int, int]]:
    """Where equal neighbours begin and end."""
    cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
    return list(zip([0, *cut.tolist()], [*cut.tolist(), len(keys[0])], strict=True)) if len(keys[0]) else []


COLUMNS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
PLACED = "dim int, label long, cell int, salt long, vector binary, ids binary"
#: A block: its number, first and last label; of each vector its label, list, smallest id, copies, codes, error and components; the ids of
#: vectors with copies, one behind the other; the lists that it holds and that it probes.
PACKED = "no long, dim int, first long, last long, labels binary, cells binary, ids binary, copies binary, codes binary, errors binary, vectors binary, members binary, held array<int>, probed array<int>"
LINKED, MEMBER = "id long, n long, root long", "id long, vec_id long, copies long"


def batch_of(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = pa.schema([(name, COLUMNS[kind]) for name, kind in (column.split() for column in schema.split(", "))])
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)


def packed_blocks(vectors: DataFrame, reach: float) -> tuple[DataFrame, dict[int, Index], np.dtype]:
    """The rows (vec_id, label, dim, vector) as blocks of distinct vectors, the index of each length, and the components' type."""
    spark = vectors.sparkSession
    kind = np.dtype(np.float32 if vectors.schema["vector"].dataType.elementType.simpleString() == "float" else np.float64)
    sizes = {r.dim: r.n for r in vectors.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # one row for each length of vector
    indexes = {}
    for dim, n in sizes.items():
        own = vectors.where(F.col("dim") == dim).select("vector")
        share = min(1 << 20, math.ceil((1 << 20) * 2 * SAMPLE / n))
        some = own.where(F.pmod(F.xxhash64("vector"), F.lit(1 << 20)) < share).distinct().orderBy(F.xxhash64("vector"), "vector").limit(SAMPLE).collect()
        indexes[dim] = fit(unit([r.vector for r in some or own.limit(SAMPLE).collect()]), n)
    sent = spark.sparkContext.broadcast(indexes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            ids, labels, dims = (part.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label", "dim"))
            out: dict[tuple, tuple[int, list[int]]] = {}  # equal vectors of a batch are one row
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                x = np.asarray(part.column("vector").take(pa.array(own)).flatten(), kind).reshape(-1, dim) + kind.type(0)  # no negative zeros
                for i, cell, row in zip(own.tolist(), sent.value[dim].cells(unit(x)).tolist(), x, strict=True):
                    out.setdefault((dim, int(labels[i]), row.tobytes()), (cell, []))[1].append(int(ids[i]))
            if out:
                yield batch_of(PLACED, [(dim, label, cell, zlib.crc32(raw), raw, np.unique(own).tobytes()) for (dim, label, raw), (cell, own) in out.items()])

    def block(no: int, dim: int, rows: dict[tuple[int, bytes], list[bytes]]) -> pa.RecordBatch:
        index, labels = sent.value[dim], np.array([label for label, _ in rows], np.int64)
        raw = b"".join(v for _, v in rows)
        x = unit(np.frombuffer(raw, kind).reshape(-1, dim))
        cell, codes, errors = index.code(x)
        members = [np.unique(np.frombuffer(b"".join(own), np.int64)) for own in rows.values()]
        ids, copies = np.array([m[0] for m in members], np.int64), np.array([len(m) for m in members], np.int64)
        probed = np.flatnonzero(index.probes(x, cell, reach).any(0))
        return batch_of(PACKED, [(no, dim, int(labels[0]), int(labels[-1]), labels.tobytes(), cell.tobytes(), ids.tobytes(), copies.tobytes(), codes.tobytes(), errors.tobytes(), raw, b"".join(m.tobytes() for m in members if len(m) > 1), np.unique(cell).tolist(), probed.tolist())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[tuple[int, bytes], list[bytes]] = {}
        no, last = TaskContext.get().partitionId() << 32, None
        for part in batches:
            for dim, label, cell, salt, raw, ids in zip(*(part.column(c).to_pylist() for c in ("dim", "label", "cell", "salt", "vector", "ids")), strict=True):
                if last and (dim != last[0] or len(rows) >= BLOCK and (dim, label, cell, salt) != last):  # never between equal vectors
                    yield block(no, last[0], rows)
                    rows, no = {}, no + 1
                rows.setdefault((label, raw), []).append(ids)
                last = dim, label, cell, salt
        if rows:
            yield block(no, last[0], rows)

    placed = vectors.select("vec_id", "label", "dim", "vector").mapInArrow(place, PLACED)
    total = sum(n * dim * kind.itemsize for dim, n in sizes.items())
    files = max(1, math.ceil(total / FILE), min(FILES, sum(sizes.values()) // BLOCK))
    order = ["dim", "label", "cell", "salt"]
    packed = placed.repartitionByRange(files, *order).sortWithinPartitions(*order).mapInArrow(pack, PACKED)
    return materialise(packed, "embed-blocks"), indexes, kind


class Block:
    """A block as arrays."""

    def __init__(self, row: dict, index: Index, kind: np.dtype, cosine: float):
        self.labels, self.ids, self.copies = (np.frombuffer(row[c], np.int64) for c in ("labels", "ids", "copies"))
        self.cell = np.frombuffer(row["cells"], np.int32)
        self.unit = unit(np.frombuffer(row["vectors"], kind).reshape(len(self.ids), -1))
        decoded = index.decode(self.cell, np.frombuffer(row["codes"], np.uint8).reshape(len(self.ids), -1))
        self.narrow, self.decoded = self.unit.astype(np.float32), decoded.astype(np.float32)
        self.least = (index.least(decoded, np.frombuffer(row["errors"]), cosine) - 1e-5).astype(np.float32)  # less what single precision rounds
        self.runs, self.labels_at = runs(self.labels, self.cell), runs(self.labels)


def near_pairs(q: Block, e: Block, index: Index, reach: float, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``q`` and ``e`` of every pair of one label, different ids and a cosine of ``cosine`` or more, each pair once."""
    lists, place = np.unique(e.cell, return_inverse=True)
    probing = index.probes(q.unit, q.cell, reach, lists)
    products, nears = np.empty(TILE * len(e.ids), np.float32), np.empty(TILE * len(e.ids), bool)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for start, end in e.labels_at:
        first, last = np.searchsorted(q.labels, e.labels[start], "left"), np.searchsorted(q.labels, e.labels[start], "right")
        asking = probing[first:last]
        # where most rows probe most lists, the lists are looked through as one
        parts = [(start, end)] if asking.size and asking[:, np.unique(place[start:end])].mean() > MOST else [(a, b) for a, b in e.runs if start <= a < end]
        for a, b in parts if first < last else ():
            rows = np.arange(first, last) if b - a == end - start else first + np.flatnonzero(asking[:, place[a]])
            y, least = np.ascontiguousarray(e.decoded[a:b].T), e.least[a:b]
            for i in range(0, len(rows), TILE):
                x = q.narrow[rows[i : i + TILE]]
                shape, n = (len(x), b - a), len(x) * (b - a)
                near = np.greater_equal(np.matmul(x, y, out=products[:n].reshape(shape)), least, out=nears[:n].reshape(shape))
                at, to = np.divmod(np.flatnonzero(near), b - a)
                at, to = rows[i + at], a + to
                keep = (q.ids[at] != e.ids[to]) & ((at < to) if same else True)
                at, to = at[keep], to[keep]
                for k in range(0, len(at), 200_000):
                    u, v = at[k : k + 200_000], to[k : k + 200_000]
                    exact = (q.unit[u] * e.unit[v]).sum(1) >= cosine
                    found.append((u[exact], v[exact]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def links(packed: DataFrame, indexes: dict[int, Index], kind: np.dtype, cosine: float, reach: float) -> DataFrame:
    """(id, n, root) for blocks: linked rows of other nodes, and a smaller or equal id in the same component; possibly several rows an id."""
    sent = packed.sparkSession.sparkContext.broadcast(indexes)
    carried = ["labels", "cells", "ids", "copies", "codes", "errors", "vectors"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Block] = {}
        for part in batches:
            for i in range(part.num_rows):
                r = {c: part.column(c)[i].as_py() for c in ("dim", "no", "q_no")}
                index = sent.value[r["dim"]]
                sides = []
                for side in ("q_", ""):
                    no = r[f"{side}no"]
                    if no not in held:
                        held[no] = Block({c: part.column(f"{side}{c}")[i].as_buffer() for c in carried}, index, kind, cosine)
                    sides.append(held[no])
                q, e = sides
                room = max(2, HELD // (16 * q.unit.size))
                while len(held) > room:  # the oldest but those of this pair
                    del held[next(no for no in held if no not in (r["no"], r["q_no"]))]
                at, to = near_pairs(q, e, index, reach, cosine, r["no"] == r["q_no"])
                if len(at):
                    both = np.unique(np.concatenate([q.ids[at], e.ids[to]]))
                    a, b = np.searchsorted(both, q.ids[at]), np.searchsorted(both, e.ids[to])
                    n = np.bincount(a, e.copies[to], len(both)) + np.bincount(b, q.copies[at], len(both))
                    root = both[local_roots(len(both), a, b)]
                    yield pa.RecordBatch.from_arrays([pa.array(both), pa.array(n.astype(np.int64)), pa.array(root)], names=["id", "n", "root"])

    pick = [*carried, "dim", "no", "first", "last"]
    q = packed.select(*[F.col(c).alias(f"q_{c}") for c in pick], F.col("probed").alias("q_probed"))
    # each pair once; ranges of labels, not equal keys: so the files meet as they lie and nothing is dealt out again
    meets = (F.col("q_no") <= F.col("no")) & (F.col("q_dim") <= F.col("dim")) & (F.col("q_dim") >= F.col("dim")) & (F.col("q_first") <= F.col("last")) & (F.col("q_last") >= F.col("first")) & F.arrays_overlap("q_probed", "held")
    pairs = q.join(packed.select(*pick, "held"), meets)
    return pairs.select("dim", "no", "q_no", *[f"{side}{c}" for side in ("q_", "") for c in carried]).mapInArrow(meet, LINKED)


def repeated(packed: DataFrame) -> DataFrame:
    """(id, vec_id, copies): the ids of every vector that more than one has, by their smallest."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for ids, copies, members in zip(*(part.column(c).to_pylist() for c in ("ids", "copies", "members")), strict=True):
                ids, copies, members = (np.frombuffer(c, np.int64) for c in (ids, copies, members))
                ids, copies = ids[copies > 1], copies[copies > 1]
                if len(ids):
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, copies)), pa.array(members), pa.array(np.repeat(copies, copies))], names=["id", "vec_id", "copies"])

    return packed.select("ids", "copies", "members").mapInArrow(tell, MEMBER)


def near_duplicates(table: DataFrame, cosine: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``table`` (vec_id, embedding, label)."""
    rows = table.select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    fit_to_link = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding")) & F.exists("embedding", lambda x: x != 0)
    single = rows.schema["embedding"].dataType.elementType == T.FloatType()
    vector = F.col("embedding") if single else F.col("embedding").cast("array<double>")
    vectors = rows.where(fit_to_link).select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.size("embedding").alias("dim"), vector.alias("vector"))
    reach = float(np.sqrt(2 - 2 * cosine)) + 1e-6
    packed, indexes, kind = packed_blocks(vectors, reach)
    found = materialise(links(packed, indexes, kind, cosine, reach), "embed-links")
    others = found.groupBy("id").agg(F.sum("n").alias("n"))
    copies = repeated(packed)
    # an id that comes with several vectors ties them together, and its copies tie it to their smallest id
    component = components(found.select(F.col("root").alias("a"), F.col("id").alias("b")).unionByName(copies.select(F.col("id").alias("a"), F.col("vec_id").alias("b"))))
    told = copies.select("vec_id", "id").unionByName(others.select(F.col("id").alias("vec_id"), "id")).distinct().join(others, "id").select("vec_id", "n")
    own = told.unionByName(copies.select("vec_id", (F.col("copies") - 1).alias("n"))).groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    per_id = own.join(component.withColumnRenamed("id", "vec_id"), "vec_id", "full")
    out = rows.select("vec_id").join(per_id, "vec_id", "left")
    component_id = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), F.coalesce(F.col("vec_id") == component_id, F.lit(True)).alias("kept"))


def op6_embed_dedup(spark, sf_dir: str) -> DataFrame:
    """Groups of vectors of one label with a cosine of 0.93 or more, over all ``embeddings``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
