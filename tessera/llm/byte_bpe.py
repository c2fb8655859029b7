"""Byte-level BPE by corpus-level merge replay.

A block of texts is split by the tokenizer's pattern; its distinct pieces are
looked up as whole tokens; the others are laid out as one byte sequence, and an inverted index from mergeable pair (by
the rank of what it makes) to positions drives the merges: the lowest rank is
applied at all its positions, left to right, and only the neighbours of a merge
are looked up again and indexed.  Words share the replay, so each distinct piece
is encoded once a block, and a piece of a million letters costs n log n.

The ranks are read on the driver and sent to the tasks: the vocabulary file is
a parameter of fixed size, whatever the corpus.

Defined cases: a null or empty text has no ids and decodes to no bytes; a byte
that the vocabulary lacks raises an error in :func:`load_ranks`; repeated rows
are encoded alike; an empty table gives an empty result; columns that clash
with the added ones are replaced.
"""

from __future__ import annotations

import base64
import gc
import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.rows import named, packed, unpacked

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Texts encoded at a time, and distinct pieces remembered between blocks of a task (both bound memory only).
BLOCK_CHARS, REMEMBERED = 8_000_000, 600_000


def load_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank from a tiktoken file; every single byte must have one."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"the vocabulary lacks the bytes {missing[:5]}")
    return ranks


def mergeable(ranks: dict[bytes, int]) -> dict[int, int]:
    """left id * 2^32 + right id -> rank of what the two make, for every pair that makes a token."""
    pairs = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            left, right = ranks.get(token[:i]), ranks.get(token[i:])
            if left is not None and right is not None:
                pairs[left << 32 | right] = rank
    return pairs


def first_merges(ranks: dict[bytes, int], pairs: dict[int, int]) -> np.ndarray:
    """[left byte, right byte]: rank of what the two make, or -1."""
    single = [ranks[bytes([b])] for b in range(256)]
    return np.array([[pairs.get(left << 32 | right, -1) for right in single] for left in single], np.int64)


def replay(pieces: list[bytes], ranks: dict[bytes, int], pairs: dict[int, int], first: np.ndarray | None = None) -> list[bytes]:
    """Ids (little-endian unsigned 32-bit) of each distinct piece: its own if it is a token, else by replaying all merges over all pieces at once."""
    whole = [ranks.get(p) for p in pieces]
    merged = iter(merge([p for p, rank in zip(pieces, whole, strict=True) if rank is None], ranks, pairs, first_merges(ranks, pairs) if first is None else first))
    return [next(merged) if rank is None else rank.to_bytes(4, "little") for rank in whole]


def merge(pieces: list[bytes], ranks: dict[bytes, int], pairs: dict[int, int], first: np.ndarray) -> list[bytes]:
    if not pieces:
        return []
    single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
    raw = np.frombuffer(b"\0" + b"\0".join(pieces) + b"\0", np.uint8)
    starts = 1 + np.cumsum([0, *(len(p) + 1 for p in pieces)])  # a piece and the gap behind it
    ids = single[raw]
    ids[starts - 1] = -1  # no pair crosses a gap
    made = np.where((ids[:-1] >= 0) & (ids[1:] >= 0), first[raw[:-1], raw[1:]], -1)
    order = np.argsort(made, kind="stable")[np.count_nonzero(made < 0) :]
    rank, at = np.unique(made[order], return_index=True)
    index = dict(zip(rank.tolist(), (x.tolist() for x in np.split(order, at[1:])), strict=True)) if len(order) else {}
    queue = list(index)  # ascending, so a heap
    token, after, before = ids.tolist(), list(range(1, len(ids) + 1)), [0, *range(len(ids) - 1)]
    while queue:
        rank = heapq.heappop(queue)
        places = index.pop(rank)
        places.sort()
        for n, at in enumerate(places):
            left, gone = token[at], after[at]
            if left < 0 or token[gone] < 0 or pairs.get(left << 32 | token[gone]) != rank:
                continue  # an earlier merge took one of the two
            right, lower = after[gone], False
            token[at], token[gone], after[at], before[right] = rank, -1, right, at
            if token[right] >= 0 and (made := pairs.get(rank << 32 | token[right])) is not None:
                if made in index:
                    index[made].append(at)
                else:
                    index[made] = [at]
                    heapq.heappush(queue, made)
                lower = made < rank
            left = before[at]
            if token[left] >= 0 and (made := pairs.get(token[left] << 32 | rank)) is not None:
                if made in index:
                    index[made].append(left)
                else:
                    index[made] = [left]
                    heapq.heappush(queue, made)
                lower = lower or made < rank
            if lower:  # that one comes first
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(queue, rank)
                index[rank].extend(places[n + 1 :])
                break
    ids = np.array(token)
    ends = 4 * np.cumsum(np.add.reduceat(ids >= 0, starts[:-1]))
    coded = ids[ids >= 0].astype("<u4").tobytes()
    return [coded[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]


class Seen(dict):
    """piece -> its number, given at first sight."""

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        return number


def blocks(texts: list[str | None]) -> Iterator[slice]:
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= BLOCK_CHARS:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


class Encoder:
    """Encodes blocks of texts; pieces seen in earlier blocks of the task are remembered."""

    def __init__(self, ranks: dict[bytes, int], pairs: dict[int, int], pattern: str):
        import regex

        self.ranks, self.pairs, self.find = ranks, pairs, regex.compile(pattern).findall
        self.seen, self.ids, self.first = Seen(), [], first_merges(ranks, pairs)
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.seen) > REMEMBERED:
            self.seen, self.ids = Seen(), []
        split = [np.fromiter(map(self.seen.__getitem__, self.find(text or "")), np.int32) for text in texts]
        new = islice(self.seen, len(self.ids), None)
        self.ids += replay([piece.encode() for piece in new], self.ranks, self.pairs, self.first)
        return [b"".join(map(self.ids.__getitem__, numbers.tolist())) for numbers in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(df: DataFrame, path: str | None = None, pattern: str | None = None, text: str = "text", outputs: tuple[str, ...] = ("token_ids",)) -> DataFrame:
    """All columns but ``text``, plus any of ``token_ids`` (array of int), ``ids_le`` (the ids as
    little-endian unsigned 32-bit integers) and ``decoded`` (the bytes that the ids decode to)."""
    import public_tokenizers

    ranks = load_ranks(path or public_tokenizers.path(VOCABULARY))
    sent = df.sparkSession.sparkContext.broadcast((ranks, mergeable(ranks)))
    pattern = pattern or public_tokenizers.PATTERN
    source = df.select(packed(df, (text, *outputs)).alias("row"), named(text).alias("text"))
    kinds = {"token_ids": T.ArrayType(T.IntegerType(), False), "ids_le": T.BinaryType(), "decoded": T.BinaryType()}
    schema = T.StructType([source.schema["row"], *[T.StructField(name, kinds[name], False) for name in outputs]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # nothing here is cyclic, and the many small objects would be gone through again and again
        encoder = Encoder(*sent.value, pattern)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in blocks(texts):
                rows = batch.slice(part.start, part.stop - part.start)
                ids = encoder.encode(texts[part])
                columns = [rows.column("row")]
                for name in outputs:
                    if name == "token_ids":
                        ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype="int32")
                        columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<u4").astype("int32"))))
                    else:
                        columns.append(pa.array(ids if name == "ids_le" else [encoder.decode(x) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    found = source.mapInArrow(run, schema)
    return found.select(*unpacked(found, df, (text, *outputs)), *outputs)


def op5_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` encoded and decoded; digests of both."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, outputs=("ids_le", "decoded")).select(
        "doc_id", (F.octet_length("ids_le") / 4).cast("long").alias("n_tokens"), F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
