"""Best-fit packing: patterns of few document lengths fitted by non-negative least squares.

:func:`tokenise` turns every text into token ids with an end id behind them and
cuts what exceeds the capacity.  :func:`pack` gives each piece a sequence and a
place in it:

1. Lengths are counted over all pieces (one row a length goes to the driver).
2. Lengths are put into classes of equal width; every multiset of at most
   ``most`` classes that fills a sequence is a pattern.  Non-negative least
   squares fits how often each pattern is used so that the patterns' classes
   sum to the histogram; counts are rounded down to whole ones that the
   histogram still holds.
3. The exact lengths of a class go to its patterns from the longest down; what
   is left of the histogram is packed by best fit, longest first, into the gaps
   of those sequences and then into new ones.  Equal lengths are placed
   together, so this works on counts and not on pieces.
4. The plan is a list of slots (length, first rank, repeats, sequence, offset),
   bounded by the number of lengths and patterns and not by the rows.  Pieces of a
   length are numbered in their tasks, the tasks' counts give each task its first
   number, and a binary search finds the slot of each piece.

Only lengths are planned on the driver: at most ``capacity`` counts and some ten
slots a length, for any number of rows.  No piece is sorted and no length is
gathered into one task, however many pieces have it.

Defined cases: a null or empty text is the end id alone; rows that repeat or
lack an id are documents of their own; an empty table gives an empty result;
other columns are kept whatever their names, those named like an added one are
replaced.
"""

from __future__ import annotations

import bisect
import gc
import json
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.llm.rows import named, packed, unpacked
from tessera.session import materialise

VOCABULARY = "word_bpe_49k.json"
#: Tokens of a sequence; the id that ends a document.
CAPACITY, END_ID = 4096, 1
#: Classes of lengths and most documents of a pattern, as tried in turn; the plan with the fewest sequences is taken.
GRIDS = ((512, 2), (256, 3), (128, 4))
#: Pieces remembered by a task, bytes of text taken at a time and tokens of an outgoing batch (all bound memory only).
REMEMBERED, BATCH_BYTES, BATCH_TOKENS = 300_000, 4_000_000, 1_000_000

# ----------------------------------------------------------------------------- tokens
#: Letters whose case, class and normal form do not depend on the Unicode version or on their neighbours.
LETTERS = "a-zA-ZÀ-ÖØ-öø-įı-ňŊ-ž"
#: What the fixed path stands for: the steps of the vocabulary file before its merges.
KNOWN_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None, "truncation": None, "padding": None,
}


def byte_letters() -> dict[int, int]:
    """Byte -> code point by which a byte-level vocabulary writes it: itself if printable, else 256 and up in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


def gathered(flat: np.ndarray, lengths: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The chosen lists in turn, of lists that stand in ``flat`` one behind the other."""
    many = lengths[chosen]
    before = np.cumsum(lengths) - lengths
    return flat[np.repeat(before[chosen] - (np.cumsum(many) - many), many) + np.arange(many.sum())]


class Tokens:
    """Ids of texts, a batch of texts at a time.

    No token of the known steps spans ASCII white space and no step looks across it,
    so the ids of a text are those of its words in turn.  A batch's words are numbered
    once; those of plain letters, ASCII digits and signs are split here into the pieces
    that the vocabulary's merges work on, all others go through the library whole.
    A vocabulary with other steps gets whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            steps = json.load(f)
        self.by_word = all(steps.get(k) == v for k, v in KNOWN_STEPS.items()) and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in steps["added_tokens"])
        self.special = [t["content"] for t in steps["added_tokens"]]
        self.whole = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.whole.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.whole.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True  # each piece ends in one of these, and no other token of it does
        self.pieces: dict[str, bytes] = {"\n": b""}
        self.letters = byte_letters()
        low = "a-zß-öø-ž"
        self.find = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{low}]+|[0-9]|[^0-9{low}\n]+|\n").findall

    def library(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")

    def learn(self, pieces: list[str]) -> None:
        """Ids of pieces that are not known yet."""
        if len(self.pieces) > REMEMBERED:
            self.pieces = {"\n": b""}
        new = [p for p in pieces if p not in self.pieces]
        written = [p if p.isascii() else p.encode().decode("latin-1").translate(self.letters) for p in new]
        parts = [np.zeros(0, "<u4")]
        for i in range(0, len(new), 500):  # few at a time: the library's results are large
            parts.append(np.array(self.merges.encode(" ".join(written[i : i + 500]), add_special_tokens=False).ids, "<u4"))
        ids = np.concatenate(parts)
        stops = 4 * (np.flatnonzero(self.ends[ids]) + 1)
        coded = ids.tobytes()
        self.pieces.update(zip(new, (coded[a:b] for a, b in zip([0, *stops.tolist()], stops.tolist(), strict=False)), strict=True))

    def words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words one behind the other, and how many each has."""
        plain = pc.match_substring_regex(words, rf"^[!-~{LETTERS}]*$")
        for s in self.special:
            plain = pc.and_not(plain, pc.match_substring(words, s))
        chosen = pc.utf8_lower(words.filter(plain))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(chosen)], pa.int32()), chosen), "\n")[0].as_py() + "\n" if len(chosen) else ""
        split = pa.array(self.find(joined), pa.string()).dictionary_encode()
        pieces = split.dictionary.to_pylist()
        self.learn(pieces)
        coded = [self.pieces[p] for p in pieces]
        many, numbers = np.array([len(c) // 4 for c in coded], np.int64), split.indices.to_numpy()
        flat = gathered(np.frombuffer(b"".join(coded), "<u4"), many, numbers)
        lengths = np.zeros(len(words), np.int64)
        at = np.flatnonzero(plain.to_numpy(zero_copy_only=False))
        if len(at):
            closes = np.flatnonzero(numbers == pieces.index("\n"))
            lengths[at] = np.diff(np.cumsum(many[numbers])[closes], prepend=0)
        if len(at) < len(words):
            other = np.setdiff1d(np.arange(len(words)), at)
            odd = [self.library(words[int(i)].as_py()) for i in other]
            lengths[other] = [len(x) for x in odd]
            is_odd = np.zeros(len(words), bool)
            is_odd[other] = True
            both = np.empty(lengths.sum(), "<u4")
            of_odd = np.repeat(is_odd, lengths)
            both[of_odd], both[~of_odd] = np.concatenate(odd), flat
            flat = both
        return flat, lengths

    def encode(self, texts: pa.StringArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first text, ids of the texts one behind the other, how many each has), for some texts at a time."""
        if not self.by_word:
            for i, text in enumerate(texts):
                ids = self.library(text.as_py())
                yield i, ids, np.array([len(ids)])
            return
        split = pc.ascii_split_whitespace(texts)
        first = split.offsets.to_numpy().astype(np.int64)
        words = split.values.slice(first[0], first[-1] - first[0]).dictionary_encode()
        flat, lengths = self.words(words.dictionary)
        numbers, first = words.indices.to_numpy(), first - first[0]
        before = np.concatenate([[0], np.cumsum(lengths[numbers])])[first]  # ids before each text
        start = 0
        while start < len(texts):
            stop = max(start + 1, int(np.searchsorted(before, before[start] + BATCH_TOKENS)) - 1)
            yield start, gathered(flat, lengths, numbers[first[start] : first[stop]]), np.diff(before[start : stop + 1])
            start = stop


def tokenise(docs: DataFrame, path: str | None = None, text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row a piece: the other columns of ``docs``, ``piece`` (from 0), ``start`` (ids before it), ``length``
    and ``ids_le`` (its ids as little-endian unsigned 32-bit integers)."""
    import public_tokenizers

    path = path or public_tokenizers.path(VOCABULARY)
    added = ("piece", "start", "length", "ids_le")
    source = docs.select(packed(docs, (text, *added)).alias("row"), F.coalesce(named(text), F.lit("")).alias("text"))
    schema = T.StructType([source.schema["row"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_le", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # nothing here is cyclic, and the many small objects would be gone through again and again
        tokens = Tokens(path)
        for whole in batches:
            for batch in sliced(whole, BATCH_BYTES):
                for first, flat, many in tokens.encode(batch.column("text")):
                    n = many + 1
                    stop = np.cumsum(n)
                    ids, own = np.full(stop[-1], end_id, "<u4"), np.ones(stop[-1], bool)
                    own[stop - 1] = False
                    ids[own] = flat
                    parts = -(-n // capacity)
                    at = np.repeat(np.arange(len(n)), parts)
                    piece = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
                    start = piece * capacity
                    length = np.minimum(capacity, n[at] - start)
                    ends = np.concatenate([[0], 4 * np.cumsum(length)]).astype(np.int32)
                    coded = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(ids)])
                    columns = [batch.column("row").take(pa.array(first + at)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), coded]
                    yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    found = source.mapInArrow(run, schema)
    return found.select(*unpacked(found, docs, (text, *added)), *added)


def sliced(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``most`` bytes of text (one text may have more)."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


# ----------------------------------------------------------------------------- plan
def patterns(classes: int, most: int) -> np.ndarray:
    """Every multiset of at most ``most`` classes (1 to ``classes``) that sums to ``classes``; rows padded with 0."""
    rows = np.zeros((1, 0), np.int64)
    left, least = np.array([classes]), np.array([1])
    found = []
    for n in range(1, most + 1):
        found.append(np.hstack([rows, left[:, None], np.zeros((len(rows), most - n), np.int64)])[left >= least])
        if n == most:
            break
        many = np.maximum(0, left // 2 - least + 1)  # the next class, from ``least`` to what leaves as much again
        again = np.repeat(np.arange(len(rows)), many)
        chosen = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + least[again]
        rows, left, least = np.hstack([rows[again], chosen[:, None]]), left[again] - chosen, chosen
    return np.concatenate(found)


def least_squares(made: np.ndarray, wanted: np.ndarray, steps: int) -> np.ndarray:
    """Non-negative x for which the patterns' classes, x times each, come nearest to ``wanted`` (active sets; at most one pattern a class is used).

    ``wanted`` counts by class, class 0 being padding.  Classes weigh by their size, as a long piece left over costs more.
    """
    weight = np.arange(len(wanted)) / len(wanted)
    target, x, used = wanted * weight, np.zeros(len(made)), []

    def columns(chosen: list[int]) -> np.ndarray:
        a = np.zeros((len(wanted), len(chosen)))
        np.add.at(a, (made[chosen].T, np.arange(len(chosen))), 1)
        return a * weight[:, None]

    for _ in range(steps):
        rest = target - columns(used) @ x[used] if used else target
        gain = (rest * weight)[made].sum(1)
        gain[used] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= 1e-9 * max(1.0, target.max()):
            break
        used.append(best)
        while True:
            a = columns(used)
            s = np.linalg.solve(a.T @ a + 1e-9 * np.eye(len(used)), a.T @ target)
            if s.min() > 0:
                break
            old, low = x[used], s <= 0
            step = (old[low] / (old[low] - s[low])).min()
            moved = old + step * (s - old)
            x[used] = 0
            used = [u for u, v in zip(used, moved, strict=True) if v > 1e-9]
            x[used] = moved[moved > 1e-9]
            if not used or best not in used:
                break
        if best not in used:
            break
        x[used] = s
    return x


def best_fit(counts: dict[int, int], capacity: int, groups: list[list]) -> list[list]:
    """Places ``counts`` (length -> pieces), longest first, where the least room stays; equal lengths at once.

    A group is [sequences, room left, [(length, pieces of it in each sequence), ...]].
    """
    by_room: dict[int, list[list]] = defaultdict(list)
    for g in groups:
        by_room[g[1]].append(g)
    rooms, done = sorted(by_room), []

    def put(many: int, room: int, inside: list) -> None:
        if not many:
            return
        if room not in by_room or not by_room[room]:
            if room not in by_room:
                bisect.insort(rooms, room)
            by_room[room] = []
        by_room[room].append([many, room, inside])

    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        many = counts[length]
        while many:
            at = bisect.bisect_left(rooms, length)
            while at < len(rooms) and not by_room[rooms[at]]:
                del by_room[rooms[at]], rooms[at]
            if at == len(rooms):
                each = capacity // length
                put(many // each, capacity - each * length, [(length, each)])
                if many % each:
                    put(1, capacity - many % each * length, [(length, many % each)])
                break
            sequences, room, inside = by_room[rooms[at]].pop()
            each = room // length
            full = min(sequences, many // each)
            put(full, room - each * length, [*inside, (length, each)])
            many -= full * each
            sequences -= full
            if sequences and 0 < many < each:
                put(1, room - many * length, [*inside, (length, many)])
                sequences, many = sequences - 1, 0
            put(sequences, room, inside)
    for group in by_room.values():
        done += group
    return done


def plan_groups(histogram: dict[int, int], capacity: int, classes: int, most: int) -> list[list]:
    """The groups of equal sequences for one grid: fitted patterns, then the rest by best fit."""
    classes = min(classes, capacity)
    class_of = {n: -(-n * classes // capacity) for n in histogram}
    pools: dict[int, list[list[int]]] = defaultdict(list)  # class -> [length, pieces left], the longest last
    for n in sorted(histogram):
        pools[class_of[n]].append([n, histogram[n]])
    wanted = np.zeros(classes + 1)
    for n, c in histogram.items():
        wanted[class_of[n]] += c
    left = wanted.astype(np.int64)
    made = patterns(classes, most)
    made = made[((wanted[made] > 0) | (made == 0)).all(1)]
    groups: list[list] = []
    if len(made):
        fitted = least_squares(made, wanted, 3 * classes)
        for j in np.argsort(-fitted, kind="stable"):
            if fitted[j] < 1:
                break
            inside, times = np.unique(made[j][made[j] > 0], return_counts=True)
            repeats = int(min(int(fitted[j]), (left[inside] // times).min()))
            left[inside] -= repeats * times
            while repeats:  # as many sequences as the lengths at hand allow are alike
                take: dict[int, int] = defaultdict(int)
                for c in made[j][made[j] > 0].tolist():
                    depth = 0
                    while pools[c][-1 - depth][1] <= take[pools[c][-1 - depth][0]]:
                        depth += 1
                    take[pools[c][-1 - depth][0]] += 1
                same = min([repeats, *(pool[1] // take[pool[0]] for c in inside.tolist() for pool in pools[c][-most - 1 :] if take.get(pool[0]))])
                for c in inside.tolist():
                    for pool in pools[c][-most - 1 :]:
                        if pool[0] in take:
                            pool[1] -= same * take[pool[0]]
                    while pools[c] and not pools[c][-1][1]:
                        pools[c].pop()
                groups.append([same, capacity - sum(n * k for n, k in take.items()), sorted(take.items(), reverse=True)])
                repeats -= same
    rest = {n: c for pool in pools.values() for n, c in pool if c}
    return best_fit(rest, capacity, groups)


def plan(histogram: dict[int, int], capacity: int = CAPACITY, grids: tuple[tuple[int, int], ...] = GRIDS) -> np.ndarray:
    """Slots for every length: rows (length, first rank, pieces a sequence, first sequence, offset), by length and rank.

    The pieces of a length from ``first rank`` on, up to the next slot's, go ``pieces a sequence`` at a time into the
    sequences from ``first sequence`` on, from ``offset`` on.
    """
    best = min((plan_groups(histogram, capacity, *grid) for grid in grids), key=lambda groups: sum(g[0] for g in groups))
    used, sequence, slots = defaultdict(int), 0, []
    for many, _, inside in best:
        offset = 0
        for length, each in inside:
            slots.append((length, used[length], each, sequence, offset))
            used[length] += many * each
            offset += length * each
        sequence += many
    return np.array(sorted(slots), np.int64).reshape(-1, 5)


# ----------------------------------------------------------------------------- pieces to places
def pack(pieces: DataFrame, length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` plus ``sequence_id`` and ``offset`` (long): every length from 1 to ``capacity`` gets a place."""
    added = ("sequence_id", "offset")
    source = pieces.select(packed(pieces, added).alias("row"), named(length).cast("long").alias("length"))
    kinds = [T.StructField(n, T.LongType()) for n in ("length", "task", "nth")]
    schema = T.StructType([source.schema["row"], *kinds])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, task = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            lengths = batch.column("length").to_numpy(zero_copy_only=False)
            if len(lengths) and not (lengths.min() >= 1 and lengths.max() <= capacity):
                raise ValueError(f"lengths must be 1 to {capacity}")
            order = np.argsort(lengths, kind="stable")
            kind, first, many = np.unique(lengths[order], return_index=True, return_counts=True)
            nth = np.empty(len(lengths), np.int64)
            nth[order] = np.arange(len(lengths)) - np.repeat(first, many) + np.repeat(seen[kind], many)
            seen[kind] += many
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(lengths), pa.array(np.full(len(lengths), task)), pa.array(nth)], names=[f.name for f in schema])

    numbered = materialise(source.mapInArrow(number, schema), "pack-numbered")
    counts = materialise(numbered.groupBy("length", "task").agg(F.count("*").alias("n")), "pack-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row a length
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    firsts = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    slots = plan(histogram, capacity)
    shift = 62 - int(capacity).bit_length()
    sent = pieces.sparkSession.sparkContext.broadcast((slots[:, 0] << shift | slots[:, 1], slots))
    placed = T.StructType([source.schema["row"], *[T.StructField(n, T.LongType()) for n in added]])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, slots = sent.value
        for batch in batches:
            lengths, rank = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            at = np.searchsorted(keys, lengths << shift | rank, side="right") - 1
            _, first, each, sequence, offset = slots[at].T if len(at) else np.zeros((5, 0), np.int64)
            since = rank - first
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sequence + since // each), pa.array(offset + since % each * lengths)], names=[f.name for f in placed])

    ranked = numbered.join(firsts, ["length", "task"]).select("row", "length", (F.col("first") + F.col("nth")).alias("rank"))
    done = ranked.mapInArrow(place, placed)
    return done.select(*unpacked(done, pieces, added), *added)


def op13_best_fit_pack(spark, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` tokenised and packed into sequences of 4,096 tokens."""
    pieces = tokenise(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids_le").alias("ids_crc32"))
    return pack(digests)
