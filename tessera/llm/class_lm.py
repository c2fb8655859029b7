"""Scoring texts by a Brown class-based bigram model.

Words are in classes; P(word | word before) = P(class | class before) P(word | class).
Exchange clustering finds the classes: a unit moves to the class in which the
likelihood of the class bigrams is highest.  It is done in two steps.

1. Units are the most frequent words, the end token, and groups of all other words
   that share the hash of their first and last two bytes.  They start dealt out by
   frequency; half of them move in each round, until the rounds are used up or the
   likelihood stops rising, and the classes of the best round are taken.
2. Every other word of at least ``least`` training occurrences, whatever its length
   and however many there are, moves from its group's class to the best one for its
   own contexts (the classes before and after all its occurrences).  The move stands
   only if the likelihood of the recounted class bigrams rises.  Words below ``least``
   back off to their group's class; ``least=None`` leaves step 2 out.

What is counted covers all training texts.  Texts are turned once into blocks of
word numbers (written to the shared folder): up to 200,000 of the most frequent words
of at most 64 bytes are numbered alike everywhere (a bounded table sent to the tasks,
only a shorter way to the same counts and classes), the others are listed in each
block and get their count and class by a join of (block, word) rows.  Unit bigrams are
at most the square of the number of units after the sum; the contexts of a word are
one row a block, summed in the order of words with at most 2 x classes numbers each.

P(class | class before) is smoothed by adding five times P(class); a share u of
the probability, the training texts' singletons over their tokens and singletons, is
set aside for one event, "a word never seen"; with the known words it sums to 1.
Perplexity is 10^(-score / n_tokens).

Defined cases: a null or empty text is the end token alone; rows without a doc_id
are scored but not learnt from (held out); repeated rows count each; a word of any
length is a word; an empty table gives an empty result, and without training texts
every token has probability 1; extra columns play no part.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import materialise

#: Longest word of the dictionary, in bytes.
LONGEST = 64
BLOCK = "block long, numbers binary, lengths binary, doc_ids array<long>, held array<boolean>, others binary"
CLASSED = "lengths binary, doc_ids array<long>, held array<boolean>, classes binary, known binary, base binary, part binary"
#: One of a word's contexts: the class before it, or the number of classes plus the class after it; how often.
CONTEXT = np.dtype([("code", "u1"), ("n", "<u4")])
#: Added to the class of a token that no training text has.
UNSEEN = 128


@dataclass(frozen=True)
class Shape:
    units: int = 4096  # words that are units by themselves
    groups: int = 1024  # of the other words
    classes: int = 64
    rounds: int = 7  # of clustering the units, at most
    dictionary: int = 200_000  # words sent to the tasks
    smooth: float = 5.0
    block: int = 1_000_000  # tokens handled at a time
    least: int | None = None  # occurrences from which any other word has a class of its own

    @property
    def size(self) -> int:
        """Units in all; the last is the end token."""
        return self.units + self.groups + 1

    def group_of(self, word: bytes) -> int:
        return self.units + zlib.crc32(word[:2] + b" " + word[-2:]) % self.groups


def tokens(text: bytes | None) -> list[bytes]:
    """bytes.lower() lowers A-Z only, bytes.split() splits at the six ASCII white spaces only."""
    return text.lower().split() if text else []


class Numbers(dict):
    """word -> number: of the dictionary, or of words met in this block."""

    def __init__(self, words: list[bytes]):
        super().__init__((w, i) for i, w in enumerate(words))
        self.others: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.others.append(word)
        return number

    def forget(self) -> None:
        for word in self.others:
            del self[word]
        self.others = []


def dictionary_units(words: list[bytes], shape: Shape) -> np.ndarray:
    """Unit of each dictionary word, then of the end."""
    own = [i if i < shape.units else shape.group_of(w) for i, w in enumerate(words)]
    return np.array([*own, shape.size - 1])


def squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def expanded(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return pa.decompress(data[8:], size, codec="zstd", asbytes=True) if size else b""


def numbers_of(row: dict) -> np.ndarray:
    """A block's word numbers; they are kept as four planes of bytes, which compress better."""
    return np.ascontiguousarray(np.frombuffer(expanded(row["numbers"]), np.uint8).reshape(4, -1).T).view("<i4").ravel()


def others_of(row: dict) -> list[bytes]:
    """A block's own words; no word has a space."""
    return expanded(row["others"]).split(b" ")[:-1]


def encode(docs: DataFrame, words: Broadcast, shape: Shape) -> DataFrame:
    """``docs`` (doc_id, text, held_out) as blocks of whole texts, an end after each text.

    Numbers: dictionary words, then the end, then the block's ``others``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers([*words.value, b" "])  # no word has a space
        streams, ids, held, size, block = [], [], [], 0, TaskContext.get().partitionId() << 32

        def written() -> pa.RecordBatch:
            planes = np.concatenate(streams).astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()
            others = b"".join(w + b" " for w in numbers.others)
            columns = [[block], [squeezed(planes)], [np.array([len(x) for x in streams], np.int64).tobytes()], [ids], [held], [squeezed(others)]]
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["block", "numbers", "lengths", "doc_ids", "held", "others"])

        for batch in batches:
            for doc_id, text, out in zip(batch.column("doc_id"), batch.column("text").cast(pa.binary()), batch.column("held_out"), strict=True):
                found = tokens(text.as_py())
                found.append(b" ")
                streams.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
                ids.append(doc_id.as_py())
                held.append(out.as_py())
                size += len(found)
                if size >= shape.block:
                    yield written()
                    numbers.forget()
                    streams, ids, held, size, block = [], [], [], 0, block + 1
        if streams:
            yield written()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "held_out").mapInArrow(run, BLOCK)


def learnt(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, which of them are of training texts) of a block."""
    lengths = np.frombuffer(row["lengths"], np.int64)
    return numbers_of(row), np.repeat(~np.array(row["held"], bool), lengths)


def block_units(others: list[bytes], known: np.ndarray, shape: Shape) -> np.ndarray:
    """Unit of each number of a block; ``known`` are those of the dictionary and the end."""
    return np.concatenate([known, np.fromiter(map(shape.group_of, others), np.int64, len(others))])


def block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of all batches, one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def count_words(texts: DataFrame) -> DataFrame:
    """(word binary, n) over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").cast(pa.binary()):
                seen.update(tokens(text.as_py()))
                if len(seen) > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
                    seen = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    return texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def count_pairs(blocks: DataFrame, words: Broadcast, shape: Shape) -> DataFrame:
    """(a, b, n): how often unit b follows unit a; the end stands before a text's first word."""
    size = shape.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, codes, counts = dictionary_units(words.value, shape), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for row in block_rows(batches):
            numbers, train = learnt(row)
            units = block_units(others_of(row), known, shape)[numbers[train]]
            found, n = np.unique(np.concatenate([[size - 1], units[:-1]]) * size + units, return_counts=True) if len(units) else (codes[:0], counts[:0])
            every, place = np.unique(np.concatenate([codes, found]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([counts, n]), len(every)).astype(np.int64)  # exact below 2^53
            codes = every
        yield pa.RecordBatch.from_arrays([pa.array((codes // size).astype("int32")), pa.array((codes % size).astype("int32")), pa.array(counts)], names=["a", "b", "n"])

    return blocks.select("numbers", "lengths", "held", "others").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def x_log_x(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def best_class(before: np.ndarray, after: np.ndarray, own: int, n: int, at: int, bigrams: np.ndarray, sums: np.ndarray) -> int:
    """Class that a unit should be in: ``before``/``after`` are its counts next to each class,
    ``own`` next to itself, ``n`` in all, ``at`` its class; the bigram likelihood decides, ties stay."""
    left, right = before.astype(float), after.astype(float)
    left[at] -= own
    right[at] -= own
    rest, total = bigrams.astype(float), sums.astype(float)
    rest[at, :] -= right
    rest[:, at] -= left
    rest[at, at] -= own
    total[at] -= n
    rows = x_log_x(rest + right[None, :]) - x_log_x(rest)
    columns = x_log_x(rest + left[:, None]) - x_log_x(rest)
    inside = np.diagonal(rest)
    gain = rows.sum(1) - np.diagonal(rows) + columns.sum(0) - np.diagonal(columns)
    gain += x_log_x(inside + left + right + own) - x_log_x(inside) - 2 * (x_log_x(total + n) - x_log_x(total))
    best = int(gain.argmax())
    return best if gain[best] > gain[at] + 1e-6 else at


def contexts(pairs: DataFrame, classes: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(before, after, own): how often each unit stands next to each class, and next to itself.

    Tasks count parts of the pairs, 64 groups of units add them up; the result is
    units times classes, whatever the corpus.
    """
    size = len(classes)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, after, own = np.zeros(size * n_classes), np.zeros(size * n_classes), np.zeros(size)
        for rows in batches:
            a, b, n = rows["a"].to_numpy(), rows["b"].to_numpy(), rows["n"].to_numpy()
            after += np.bincount(a * n_classes + classes[b], n, size * n_classes)
            before += np.bincount(b * n_classes + classes[a], n, size * n_classes)
            own += np.bincount(a[a == b], n[a == b], size)
        table = np.hstack([before.reshape(size, -1), after.reshape(size, -1), own[:, None]]).astype(np.int64)
        yield pd.DataFrame({"shard": np.arange(64, dtype=np.int32), "counts": [table[i::64].tobytes() for i in range(64)]})

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": [key[0]], "counts": [np.sum([np.frombuffer(c, np.int64) for c in rows["counts"]], 0).tobytes()]})

    kind = "shard int, counts binary"
    table = np.zeros((size, 2 * n_classes + 1), np.int64)
    for r in pairs.mapInPandas(part, kind).groupBy("shard").applyInPandas(add, kind).collect():
        table[r.shard :: 64] = np.frombuffer(r.counts, np.int64).reshape(-1, table.shape[1])
    return table[:, :n_classes], table[:, n_classes:-1], table[:, -1]


def bigrams_of(after: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Class bigram counts, from what stands after each unit."""
    out = np.zeros((after.shape[1],) * 2, np.int64)
    np.add.at(out, classes, after)
    return out


def likelihood(bigrams: np.ndarray) -> float:
    """The part of the training texts' log likelihood that the classes decide."""
    return float(x_log_x(bigrams).sum() - x_log_x(bigrams.sum(0)).sum() - x_log_x(bigrams.sum(1)).sum())


def exchange(pairs: DataFrame, shape: Shape, gain: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Class of each unit, and the class bigram counts, of the round of the highest likelihood.

    Rounds end early if both halves' last moves together raised it by less than the share ``gain``.
    """
    size, n_classes = shape.size, shape.classes
    classes = np.arange(size) % (n_classes - 1)
    classes[-1] = n_classes - 1  # the end starts by itself
    best, seen = None, []
    for turn in range(shape.rounds + 1):
        before, after, own = contexts(pairs, classes, n_classes)
        bigrams = bigrams_of(after, classes)
        seen.append(likelihood(bigrams))
        if best is None or seen[-1] > best[0]:
            best = seen[-1], classes, bigrams
        if turn == shape.rounds or (turn > 2 and seen[-1] - seen[-3] <= gain * abs(seen[-3])):
            break
        sums, moved = bigrams.sum(0), classes.copy()
        for u in range(turn % 2, size, 2):
            if after[u].any() or before[u].any():
                moved[u] = best_class(before[u], after[u], own[u], before[u].sum(), classes[u], bigrams, sums)
        classes = moved
    return best[1], best[2]


def word_contexts(blocks: DataFrame, words: Broadcast, classes: np.ndarray, shape: Shape) -> DataFrame:
    """(word, contexts): what stands next to the words that aren't units; one row a word and block, a dictionary word one some blocks."""
    wide = 2 * shape.classes

    def rows(codes: np.ndarray, n: np.ndarray, names) -> Iterator[pa.RecordBatch]:
        owner = codes // wide
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        entries = np.empty(len(codes), CONTEXT)
        entries["code"], entries["n"] = codes % wide, n
        offsets = (np.append(first, len(codes)) * CONTEXT.itemsize).astype("<i4")
        packed = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(entries.tobytes())])
        yield from pa.table([pa.array([names(i) for i in owner[first].tolist()], pa.binary()), packed], names=["word", "contexts"]).to_batches(20_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = words.value
        known, size = dictionary_units(listed, shape), len(listed) + 1
        held, held_n = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of dictionary words
        for row in block_rows(batches):
            numbers, train = learnt(row)
            numbers, others = numbers[train].astype(np.int64), others_of(row)
            of = classes[block_units(others, known, shape)[numbers]]
            at = np.flatnonzero((numbers >= shape.units) & (numbers != size - 1))  # an end follows every one
            if not len(at):
                continue
            before = np.where(at > 0, of[at - 1], classes[-1])
            codes, n = np.unique(np.concatenate([numbers[at] * wide + before, numbers[at] * wide + shape.classes + of[at + 1]]), return_counts=True)
            cut = int(np.searchsorted(codes, size * wide))
            held, place = np.unique(np.concatenate([held, codes[:cut]]), return_inverse=True)
            held_n = np.bincount(place, np.concatenate([held_n, n[:cut]]), len(held)).astype(np.int64)
            if len(held) > 2_000_000:
                yield from rows(held, held_n, listed.__getitem__)
                held, held_n = held[:0], held_n[:0]
            yield from rows(codes[cut:] - size * wide, n[cut:], others.__getitem__)
        yield from rows(held, held_n, listed.__getitem__)

    return blocks.select("numbers", "lengths", "held", "others").mapInArrow(run, "word binary, contexts binary")


def best_classes(table: np.ndarray, at: np.ndarray, bigrams: np.ndarray) -> np.ndarray:
    """Class that each word should be in: a row of ``table`` holds its counts behind and before each class,
    ``at`` its class now, whose counts are without the word when its place there is weighed."""
    beside = np.vstack([bigrams, bigrams.T]).astype(float)  # by (class before | class after), own class
    sums, n_classes, out = bigrams.sum(0).astype(float), len(bigrams), np.empty(len(table), np.int64)
    beside_log, sums_log = x_log_x(beside), x_log_x(sums)
    for start in range(0, len(table), 500):
        part, here = table[start : start + 500], at[start : start + 500]
        n = part[:, :n_classes].sum(1)
        word, code = np.nonzero(part)
        r, own = part[word, code].astype(float), here[word]
        each = x_log_x(beside[code] + r[:, None]) - beside_log[code]
        row = np.arange(len(code))
        each[row, own] = beside_log[code, own] - x_log_x(np.maximum(beside[code, own] - r, 0))
        gain = np.add.reduceat(each, np.flatnonzero(np.diff(word, prepend=-1)))
        total = x_log_x(sums + n[:, None]) - sums_log
        row = np.arange(len(part))
        total[row, here] = sums_log[here] - x_log_x(np.maximum(sums[here] - n, 0))
        gain -= 2 * total
        best = gain.argmax(1)
        out[start : start + 500] = np.where(gain[row, best] > gain[row, here] + 1e-6, best, here)
    return out


def own_classes(found: DataFrame, classes: np.ndarray, bigrams: np.ndarray, shape: Shape) -> DataFrame:
    """(word, n, class) of the words of ``word_contexts``; null for those of fewer than ``shape.least`` occurrences."""
    wide = 2 * shape.classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def moved(words: list[bytes], table: np.ndarray) -> pa.RecordBatch:
            n = table[:, : shape.classes].sum(1)
            chosen = np.flatnonzero(n >= shape.least)
            at = classes[np.fromiter((shape.group_of(words[i]) for i in chosen.tolist()), np.int64, len(chosen))]
            best = np.zeros(len(words), np.int32)
            best[chosen] = best_classes(table[chosen], at, bigrams)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n, pa.int64()), pa.array(best, mask=n < shape.least)], names=["word", "n", "class"])

        last, kept = None, np.zeros((1, wide), np.int64)  # rows of a word may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column("word").dictionary_encode()
            words, place = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            contexts = batch.column("contexts").to_pylist()
            entries = np.frombuffer(b"".join(contexts), CONTEXT)
            owner = np.repeat(place, [len(c) // CONTEXT.itemsize for c in contexts])
            table = np.bincount(owner * wide + entries["code"], entries["n"], len(words) * wide).astype(np.int64).reshape(-1, wide)
            if last is not None and words[0] != last:
                yield moved([last], kept)
            elif last is not None:
                table[0] += kept[0]
            yield moved(words[:-1], table[:-1])
            last, kept = words[-1], table[-1:].copy()
        if last is not None:
            yield moved([last], kept)

    return found.repartition("word").sortWithinPartitions("word").mapInArrow(run, "word binary, n long, class int")


@dataclass
class Model:
    """What the tasks need: the dictionary with counts and classes, class of each unit, log10 P(class | class before) / n(class)."""

    shape: Shape
    words: list[bytes]
    known: np.ndarray
    classes: np.ndarray
    word_classes: np.ndarray  # of the dictionary, then the end
    step: np.ndarray | None
    ends: int
    unseen: float  # probability of a word never seen
    n_tokens: int
    n_words: int


def frequent(counts: DataFrame, most: int) -> list:
    """Rows (word, n) of at most ``most`` words, the most frequent ones; down to the same count (within 1 %) or none.

    A histogram of the counts' logarithms finds the cut, so only the chosen words reach the driver.
    """
    short = counts.where(F.length("word") <= LONGEST).withColumn("bin", F.floor(F.log2("n") * 64).cast("int"))
    cut, total = None, 0
    for r in sorted(short.groupBy("bin").agg(F.count("*").alias("words")).collect(), key=lambda r: -r.bin):  # 64 bins a doubling
        total += r.words
        if total > most:
            break
        cut = r.bin
    chosen = [] if cut is None else short.where(F.col("bin") >= cut).select("word", "n").collect()
    return sorted(chosen, key=lambda r: (-r.n, r.word))


def classify(blocks: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """Class of each token of ``blocks``, and for each text the known tokens, the base score's and the score's part that the words decide."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in block_rows(batches):
            others = others_of(row)
            yield from pa.table([np.full(len(others), row["block"], np.int64), np.arange(len(others), dtype=np.int32), pa.array(others, pa.binary())], names=["block", "place", "word"]).to_batches(20_000)

    words = blocks.select("block", "others").mapInArrow(listed, "block long, place int, word binary").join(counts, "word")
    found = words.groupBy("block").agg(F.collect_list(F.struct("place", "n", "class")).alias("found"))  # at most a block's words
    sent = blocks.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        size, units = len(m.words) + 1, dictionary_units(m.words, m.shape)
        unseen, all_ = np.log10(m.unseen), np.log10(m.n_tokens + m.n_words + 1)
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                others = others_of({"others": one.column("others")[0].as_py()})
                numbers = numbers_of({"numbers": one.column("numbers")[0].as_py()})
                lengths = np.frombuffer(one.column("lengths")[0].as_py(), np.int64)
                n, of = np.zeros(size + len(others), np.int64), np.empty(size + len(others), np.int64)
                n[: size - 1], n[size - 1], of[:size] = m.known, m.ends, m.word_classes
                of[size:] = m.classes[np.fromiter(map(m.shape.group_of, others), np.int64, len(others))]
                joined = one.column("found").flatten()
                if len(joined):
                    place, own = joined.field("place").to_numpy() + size, joined.field("class")
                    n[place] = joined.field("n").to_numpy()
                    has = own.is_valid().to_numpy(zero_copy_only=False)
                    of[place[has]] = own.drop_null().to_numpy()
                doc = np.repeat(np.arange(len(lengths)), lengths)
                times, count = n[numbers], len(lengths)
                known = np.bincount(doc, times > 0, count).astype(np.int64)
                base = np.bincount(doc, (np.log10(n + 1) - all_)[numbers], count)
                part = np.bincount(doc, np.where(n > 0, np.log10(np.maximum(n, 1)), unseen)[numbers], count)
                classes = (of[numbers] + UNSEEN * (times == 0)).astype(np.uint8)
                columns = [one.column("lengths"), one.column("doc_ids"), one.column("held"), *[pa.array([c], pa.binary()) for c in (squeezed(classes.tobytes()), known.tobytes(), base.tobytes(), part.tobytes())]]
                yield pa.RecordBatch.from_arrays(columns, names=["lengths", "doc_ids", "held", "classes", "known", "base", "part"])

    return blocks.join(found, "block", "left").select("numbers", "lengths", "doc_ids", "held", "others", "found").mapInArrow(run, CLASSED)


def class_bigrams(classed: DataFrame, shape: Shape) -> np.ndarray:
    """Class bigram counts of the training texts."""
    wide = shape.classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(wide * wide, np.int64)
        for row in block_rows(batches):
            train = np.repeat(~np.array(row["held"], bool), np.frombuffer(row["lengths"], np.int64))
            of = np.frombuffer(expanded(row["classes"]), np.uint8)[train].astype(np.int64)  # training words are all seen
            if len(of):
                seen += np.bincount(np.concatenate([of[-1:], of[:-1]]) * wide + of, minlength=wide * wide)  # the last is an end
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(seen[used])], names=["code", "n"])

    out = np.zeros(wide * wide, np.int64)
    for r in classed.select("lengths", "held", "classes").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        out[r.code] = r.n
    return out.reshape(wide, wide)


def steps(bigrams: np.ndarray, unseen: float, smooth: float) -> np.ndarray:
    """log10 P(class | class before) / n(class), with the share of the unseen taken off."""
    sums = bigrams.sum(0).astype(float)
    share = sums / max(1.0, sums.sum())
    after = (bigrams + smooth * share[None, :]) / (bigrams.sum(1, keepdims=True) + smooth)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(sums > 0, np.log10((1 - unseen) * after) - np.log10(sums), 0.0)


def learn(docs: DataFrame, shape: Shape) -> tuple[Model, DataFrame, DataFrame]:
    """From ``docs`` (doc_id, text, held_out): the model, (word, n, class) of the training words that aren't units, all texts classified."""
    texts = docs.where(~F.col("held_out")).select("text")
    counts = materialise(count_words(texts), "lm-words")
    total, distinct, single = counts.agg(F.sum("n"), F.count("*"), F.sum((F.col("n") == 1).cast("long"))).first()
    ends = texts.count()
    n_tokens, n_words = (total or 0) + ends, distinct + (ends > 0)
    unseen = (max(1, single or 0)) / (n_tokens + max(1, single or 0))
    top = frequent(counts, shape.dictionary)  # at most so many words of LONGEST bytes
    words = [bytes(r.word) for r in top]
    sent = docs.sparkSession.sparkContext.broadcast(words)
    blocks = materialise(encode(docs, sent, shape), "lm-blocks")
    classes, bigrams = exchange(materialise(count_pairs(blocks, sent, shape), "lm-pairs"), shape)
    model = Model(shape, words, np.array([r.n for r in top], np.int64), classes, classes[dictionary_units(words, shape)], None, ends, unseen, n_tokens, n_words)
    grouped = counts.withColumn("class", F.lit(None).cast("int"))
    if shape.least is not None:
        own = materialise(own_classes(word_contexts(blocks, sent, classes, shape), classes, bigrams, shape), "lm-classes")
        of = dict.fromkeys(words[shape.units :])
        if of:  # words of at least the rarest one's count are the dictionary
            of |= {bytes(r.word): r["class"] for r in own.where((F.col("n") >= top[-1].n) & (F.length("word") <= LONGEST)).select("word", "class").collect()}
        moved = np.array([*model.word_classes[: shape.units][: len(words)], *[c if of[w] is None else of[w] for w, c in zip(words[shape.units :], model.word_classes[shape.units :], strict=False)], classes[-1]], np.int64)
        refined = replace(model, word_classes=moved)
        classed = materialise(classify(blocks, refined, own), "lm-classed")
        recounted = class_bigrams(classed, shape)
        if likelihood(recounted) >= likelihood(bigrams):
            return replace(refined, step=steps(recounted, unseen, shape.smooth)), own, classed
    classed = materialise(classify(blocks, model, grouped), "lm-classed")
    return replace(model, step=steps(bigrams, unseen, shape.smooth)), grouped, classed


def fit(texts: DataFrame, shape: Shape = Shape()) -> tuple[Model, DataFrame]:
    """The model and the table (word, n, class) of the training words (without those that are units); without a class of its own a word has its group's."""
    return learn(texts.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(False).alias("held_out")), shape)[:2]


def score_classed(classed: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of each text."""
    step, n_tokens, end = model.step, model.n_tokens, int(model.classes[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in block_rows(batches):
            lengths, coded = np.frombuffer(row["lengths"], np.int64), np.frombuffer(expanded(row["classes"]), np.uint8).astype(np.int64)
            of = coded % UNSEEN
            each = np.where(coded < UNSEEN, step[np.concatenate([[end], of[:-1]]), of], 0.0)
            scores = np.bincount(np.repeat(np.arange(len(lengths)), lengths), each, len(lengths)) + np.frombuffer(row["part"])
            scores, base = np.round(scores, 9) + 0.0, np.round(np.frombuffer(row["base"]), 9) + 0.0
            columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"], pa.bool_()), lengths, np.frombuffer(row["known"], np.int64), np.full(len(lengths), n_tokens, np.int64), base, scores, 10 ** np.minimum(-scores / lengths, 300)]
            yield from pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]).to_batches()

    return classed.select("lengths", "doc_ids", "held", "classes", "known", "base", "part").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, held_out) scored by a model of other texts; columns as in ``score_classed``."""
    sent = docs.sparkSession.sparkContext.broadcast(model.words)
    blocks = materialise(encode(docs, sent, model.shape), "lm-blocks")
    return score_classed(classify(blocks, model, counts), model)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(True))


#: Every word that occurs twice is clustered by its own contexts.
PRODUCTION = Shape(least=2)


def op1_class_lm(spark, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` scored by a model of those that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    model, _, classed = learn(docs, PRODUCTION)
    return score_classed(classed, model)
