"""Prefix trie of conversations by time-forward processing.

A node is a distinct sequence of first turns; its members are the conversations
that start with it.  :func:`member_rows` gives one row for each conversation and
depth, :func:`trie` counts members and passes subtree totals up.

* A turn's place in its conversation comes from a range-partitioned sort by
  (conversation, turn), not from a group: a conversation of any length may lie in
  several tasks.  Each task hashes from where it starts; as the hash of a sequence is
  a polynomial (twice modulo 2^61 - 1, over SHA-256 digests of the turns), the state
  at each task's first conversation follows from one row a task, and the hash
  of a parent from its child's.
* A shard is the subtree below a topmost node of few members (at most 1 in 4,096 of
  all conversations, or 64), cut every ``BAND`` levels if it is deeper; so the members of a node that
  many conversations share are spread over shards.  Within a task, nodes come
  externally sorted by reverse level order, and totals wait for their parents in a
  priority queue that spills; totals of shard roots are summed by parent and go to
  the shards above, at last to the few nodes of many members.
* The members that end in a node are sorted by a range shuffle, joined in their tasks
  to texts of at most a megabyte, and hashed in that order in a stream.

The queue's spill is an unnamed file of the task, gone with it, as Spark's own are;
nothing is shared by it and a task run again makes its own.

Defined cases: rows without a conv_id take no part; a null role or text is empty;
turns are ordered by turn (null first), equal ones by the digest of role and text, and repeated
rows are turns of their own; an empty table has no node; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import materialise

#: The modulus and the two bases of a sequence's hash.
PRIME, BASES = (1 << 61) - 1, (0x9E3779B97F4A7C15 % ((1 << 61) - 1), 0xC2B2AE3D27D4EB4F % ((1 << 61) - 1))
INVERSE = tuple(pow(b, -1, PRIME) for b in BASES)
#: Rows of a conversation that share a join key; levels of a shard; totals waiting in memory; bytes of member ids hashed at a time.
STRIDE, BAND, WAITING, ENDS_BYTES = 4096, 65_536, 200_000, 1_000_000
#: A shard's root has at most this share of all conversations (or ``FEW``); a table of up to this many larger nodes is broadcast.
SHARE, FEW, BROADCAST_NODES = 4096, 64, 100_000
KEY = ["depth", "k0", "k1"]


def powers(n: int, base: int) -> list[int]:
    out = [1]
    for _ in range(n):
        out.append(out[-1] * base % PRIME)
    return out


def table(schema: str, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], names=[f.split()[0] for f in schema.split(", ")])


# ----------------------------------------------------------------------------- turns in order
TURNS = "task long, conv_id long, at long, x0 long, x1 long, chars long, o0 long, o1 long"


def in_order(conversations: DataFrame) -> DataFrame:
    """One row a turn: place in the conversation (``at``, from 0), values of the turn and hash of the turns up to it."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.length(text).alias("chars"))
    order = ["conv_id", "turn", "digest", "copy"]  # copies of a row are alike; the last key spreads them

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, conv, at, o = TaskContext.get().partitionId(), None, 0, [0, 0]
        for batch in batches:
            xs = np.frombuffer(b"".join(d.as_py()[:16] for d in batch.column("digest")), ">u8").reshape(-1, 2) % np.uint64(PRIME)
            rows = []
            for c, x in zip(batch.column("conv_id").to_pylist(), xs.tolist(), strict=True):
                if c != conv:
                    conv, at, o = c, 0, [0, 0]
                o = [(o[j] * BASES[j] + x[j]) % PRIME for j in (0, 1)]
                rows.append((task, c, at, *x, *o))
                at += 1
            a = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield table(TURNS, [*a[:5], batch.column("chars").cast(pa.int64()), *a[5:]])

    ranged = turns.withColumn("copy", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    turns = materialise(ranged.mapInArrow(local, TURNS), "trie-turns")
    # a conversation in several tasks: what each of them starts with; at most two rows a task
    parts = turns.groupBy("conv_id", "task").agg(F.max(F.struct("at", "o0", "o1")).alias("last"))
    several = parts.groupBy("conv_id").agg(F.count("*").alias("tasks")).where("tasks > 1").select("conv_id")
    starts: dict[int, list[tuple]] = {}
    state: dict[int, tuple] = {}
    for r in parts.join(several, "conv_id").orderBy("conv_id", "task").collect():
        n, o = state.get(r.conv_id, (0, (0, 0)))
        if n:
            starts.setdefault(r.task, []).append((r.conv_id, n, o))
        own = r.last.at + 1
        state[r.conv_id] = (n + own, tuple((o[j] * pow(BASES[j], own, PRIME) + (r.last.o0, r.last.o1)[j]) % PRIME for j in (0, 1)))
    if not starts:
        return turns

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = {f: batch.column(f).to_numpy().copy() for f in ("task", "conv_id", "at", "o0", "o1")}
            for task in np.unique(a["task"]).tolist():
                for conv, n, o in starts.get(task, ()):
                    for i in np.flatnonzero((a["task"] == task) & (a["conv_id"] == conv)).tolist():
                        for j in (0, 1):
                            a[f"o{j}"][i] = (o[j] * pow(BASES[j], int(a["at"][i]) + 1, PRIME) + int(a[f"o{j}"][i])) % PRIME
                        a["at"][i] += n
            yield pa.RecordBatch.from_arrays([pa.array(a[f]) if f in a else batch.column(f) for f in batch.schema.names], names=batch.schema.names)

    return turns.mapInArrow(whole, TURNS)


# ----------------------------------------------------------------------------- rebuilt conversations
MEMBERS = "conv_id long, depth long, k0 long, k1 long, p0 long, p1 long, chars long, turns long"


def member_rows(conversations: DataFrame, shared: int = 1, every: int = 100) -> DataFrame:
    """(conv_id, depth, k0, k1, p0, p1, chars, turns): a row for each conversation and depth from 0.

    k is the hash of the first ``depth`` turns, p that of one turn less, chars the code points of
    the last of them, turns the conversation's number of turns.  A conversation c is rebuilt: the first
    h turns of c - c % every, then its own after its first h; h = crc32 of c in decimal, modulo ``shared`` (1: as it is).
    """
    turns = in_order(conversations)
    head = F.when(F.col("at") < shared - 1, F.struct("at", "x0", "x1", "chars"))
    convs = materialise(turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(head)).alias("first")), "trie-conversations")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared).alias("h")
    heads = convs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("head"), F.col("first").alias("given"))  # at most 199 conversations have one head
    named = convs.select("conv_id", "n", "first", h, (F.col("conv_id") - F.col("conv_id") % every).alias("head")).join(heads, "head", "left")
    node = T.StructType([T.StructField(c, T.LongType()) for c in ("depth", "k0", "k1", "p0", "p1", "chars")])
    plan = T.StructType([*[T.StructField(c, T.LongType()) for c in ("conv_id", "n", "h", "given", "d0", "d1")], T.StructField("nodes", T.ArrayType(node))])

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """d: what turns the hash of the first own turns into that of the turns given."""
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                own, k = [0, 0], [0, 0]
                nodes = [{"depth": 0, "k0": 0, "k1": 0, "p0": None, "p1": None, "chars": 0}]
                for t in r["first"][: r["h"]]:
                    own = [(own[j] * BASES[j] + t[f"x{j}"]) % PRIME for j in (0, 1)]
                given = (r["given"] or [])[: r["h"]]
                for t in given:
                    p, k = k, [(k[j] * BASES[j] + t[f"x{j}"]) % PRIME for j in (0, 1)]
                    nodes.append({"depth": len(nodes), "k0": k[0], "k1": k[1], "p0": p[0], "p1": p[1], "chars": t["chars"]})
                rows.append({"conv_id": r["conv_id"], "n": r["n"], "h": r["h"], "given": len(given), "d0": (k[0] - own[0]) % PRIME, "d1": (k[1] - own[1]) % PRIME, "nodes": nodes})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([*[(c, pa.int64()) for c in plan.names[:-1]], ("nodes", pa.list_(pa.struct([(c, pa.int64()) for c in node.names])))]))

    plans = materialise(named.mapInArrow(start, plan), "trie-plans")
    turns_of = (F.col("given") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("turns")
    given = plans.select("conv_id", turns_of, F.explode("nodes").alias("node")).select("conv_id", "node.*", "turns")
    # own turns meet their conversation's plan by (conversation, stretch of turns), so a long one is many keys
    stretches = plans.select("conv_id", "given", "h", "d0", "d1", turns_of, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / STRIDE))).alias("stretch"))
    own = turns.where(F.col("at") >= h).withColumn("stretch", F.floor(F.col("at") / STRIDE)).join(stretches, ["conv_id", "stretch"])

    def after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = [powers(STRIDE, b) for b in BASES]
        for batch in batches:
            a = {f: batch.column(f).to_pylist() for f in ("at", "h", "x0", "x1", "o0", "o1", "d0", "d1")}
            k, p = ([], []), ([], [])
            for i, (at, h) in enumerate(zip(a["at"], a["h"], strict=True)):
                e = at - h + 1
                for j in (0, 1):
                    power = small[j][e] if e <= STRIDE else pow(BASES[j], e, PRIME)
                    here = (a[f"o{j}"][i] + a[f"d{j}"][i] * power) % PRIME
                    k[j].append(here)
                    p[j].append((here - a[f"x{j}"][i]) * INVERSE[j] % PRIME)
            depth = batch.column("given").to_numpy() + batch.column("at").to_numpy() - batch.column("h").to_numpy() + 1
            yield table(MEMBERS, [batch.column("conv_id"), depth, *k, *p, batch.column("chars"), batch.column("turns")])

    columns = [c.split()[0] for c in MEMBERS.split(", ")]
    return given.select(columns).unionByName(own.mapInArrow(after, MEMBERS))


# ----------------------------------------------------------------------------- totals
class Pending:
    """Priority queue of totals on the way to their parents; beyond ``most`` in memory a sorted run goes to an unnamed file."""

    ENTRY = struct.Struct("<6q")

    def __init__(self, most: int = WAITING):
        self.most, self.heap, self.runs = most, [], []

    def push(self, entry: tuple) -> None:
        heapq.heappush(self.heap, entry)
        if len(self.heap) > self.most:
            run = tempfile.TemporaryFile()  # noqa: SIM115
            for e in sorted(self.heap):
                run.write(self.ENTRY.pack(*e))
            run.seek(0)
            self.heap = []
            self.follow(len(self.runs), iter(lambda: run.read(self.ENTRY.size * 1024), b""))

    def follow(self, n: int, blocks: Iterator[bytes]) -> None:
        entries = (e for block in blocks for e in self.ENTRY.iter_unpack(block))
        heapq.heappush(self.runs, (next(entries), n, entries))

    def take(self, key: tuple) -> Iterator[tuple]:
        """The totals for ``key`` = (-depth, k0, k1), which no waiting one comes before."""
        while self.heap and self.heap[0][:3] == key:
            yield heapq.heappop(self.heap)
        while self.runs and self.runs[0][0][:3] == key:
            entry, n, entries = self.runs[0]
            yield entry
            if (following := next(entries, None)) is None:
                heapq.heappop(self.runs)
            else:
                heapq.heapreplace(self.runs, (following, n, entries))


#: A node (its own saving in ``saved``), or the totals that children outside the shard have sent (leaves, saved, children; no members).
STREAM = "depth long, k0 long, k1 long, p0 long, p1 long, conv_id long, n_convs long, inside boolean, leaves long, saved long, children long"


def time_forward(rows: DataFrame, *shard: str) -> DataFrame:
    """Nodes and totals from outside -> nodes with their subtree's totals.

    Nodes of a shard, and their parents unless ``inside`` is false, are in one task.
    """
    order = [F.col("depth").desc(), "k0", "k1", F.col("n_convs").asc_nulls_first()]
    spread = rows.repartition(*shard) if shard else rows.repartition(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, sent, names = Pending(), {}, [f.split()[0] for f in STREAM.split(", ")]
        key, got = None, [0, 0, 0]
        for batch in batches:
            out = []
            for row in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                depth, k0, k1, p0, p1, conv, members, inside, leaves, saved, children = row
                if (-depth, k0, k1) != key:
                    key, got = (-depth, k0, k1), [0, 0, 0]
                if members is None:
                    got = [got[0] + leaves, got[1] + saved, got[2] + children]
                    continue
                for e in waiting.take(key):
                    got = [got[0] + e[3], got[1] + e[4], got[2] + e[5]]
                leaves, saved = got[0] or 1, got[1] + saved
                out.append((*row[:8], leaves, saved, got[2]))
                if inside:
                    waiting.push((1 - depth, p0, p1, leaves, saved, 1))
            a = list(zip(*out, strict=True)) if out else [[]] * 11
            yield table(STREAM, [*a[:7], pa.array(a[7], pa.bool_()), *a[8:]])

    columns = [F.col(f.split()[0]) for f in STREAM.split(", ")]
    return spread.sortWithinPartitions(*order).select(columns).mapInArrow(run, STREAM)


def sent_up(done: DataFrame, *more: str) -> DataFrame:
    """What the roots of shards send to their parents, summed by parent."""
    up = done.where("NOT inside AND depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p0").alias("k0"), F.col("p1").alias("k1"), *more)
    return up.agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.count("*").alias("children"))


def ends(members: DataFrame) -> DataFrame:
    """(depth, k0, k1, sha): SHA-256 of the ascending decimal ids, comma-joined, of the conversations that end in a node."""
    order = [*KEY, "conv_id"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, size = None, [], 0

        def out() -> pa.RecordBatch:
            return table("depth, k0, k1, conv_id, ids", [[key[0]], [key[1]], [key[2]], [ids[0]], pa.array([",".join(map(str, ids))])])

        for batch in batches:
            for *k, c in zip(*(batch.column(n).to_pylist() for n in order), strict=True):
                if k != key or size > ENDS_BYTES:
                    if ids:
                        yield out()
                    key, ids, size = k, [], 0
                ids.append(c)
                size += 20
        if ids:
            yield out()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for *k, ids in zip(*(batch.column(n).to_pylist() for n in (*KEY, "ids")), strict=True):
                if k != key:
                    if state:
                        done.append((*key, state.hexdigest()))
                    key, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield sha_rows(done)
        if state:
            yield sha_rows([(*key, state.hexdigest())])

    def sha_rows(rows: list[tuple]) -> pa.RecordBatch:
        a = list(zip(*rows, strict=True)) if rows else [[]] * 4
        return table("depth, k0, k1, sha", [*a[:3], pa.array(a[3], pa.string())])

    last = members.where("depth = turns").select(order)
    texts = last.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(join, "depth long, k0 long, k1 long, conv_id long, ids string")
    return texts.repartition(*KEY).sortWithinPartitions(*order).select(*KEY, "ids").mapInArrow(digest, "depth long, k0 long, k1 long, sha string")


def trie(members: DataFrame) -> DataFrame:
    """Rows of :func:`member_rows` -> one row a node: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    members = materialise(members, "trie-members")
    nodes = members.groupBy(*KEY).agg(*[F.min(c).alias(c) for c in ("p0", "p1", "conv_id")], F.count("*").alias("n_convs"), F.max("chars").alias("chars"))
    nodes = materialise(nodes.select(*KEY, "p0", "p1", "conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")), "trie-nodes")
    root = nodes.where("depth = 0").select("conv_id", "n_convs").first()
    least, few = (root.conv_id, max(FEW, root.n_convs // SHARE)) if root else (None, FEW)
    top = materialise(nodes.where(F.col("n_convs") > few), "trie-top")
    many = top.select(*KEY, F.lit(True).alias("large"))
    if top.count() <= BROADCAST_NODES:
        many = F.broadcast(many)
    # a conversation's shard: its first node of few members
    shards = members.join(many, KEY, "left").groupBy("conv_id").agg(F.min(F.when(F.col("large").isNull(), F.struct(*KEY))).alias("shard"), F.max("turns").alias("turns")).where("shard is not null")
    stretches = materialise(shards.select("conv_id", F.col("shard.depth").alias("s"), F.col("shard.k0").alias("s0"), F.col("shard.k1").alias("s1"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("turns") / STRIDE))).alias("stretch")), "trie-shards")
    placed = nodes.where(F.col("n_convs") <= few).withColumn("stretch", F.floor(F.col("depth") / STRIDE)).join(stretches, ["conv_id", "stretch"])
    placed = materialise(placed.withColumn("band", F.floor((F.col("depth") - F.col("s")) / BAND)).withColumn("inside", (F.col("depth") - F.col("s")) % BAND > 0).drop("stretch"), "trie-placed")

    def stream(found: DataFrame, sent: DataFrame | None, *more: str) -> DataFrame:
        found = found.select(*[F.lit(0).cast("long").alias(c) if c in ("leaves", "children") else F.col(c) for c in columns], *more)
        if sent is None:
            return found
        return found.unionByName(sent, allowMissingColumns=True)

    columns = [f.split()[0] for f in STREAM.split(", ")]
    where, done, sent = ("s", "s0", "s1"), [], None
    bands = placed.agg(F.max("band").alias("b")).first().b  # more than one only in a shard of over BAND levels
    for band in range(bands if bands is not None else -1, -1, -1):
        rows = stream(placed.where(F.col("band") == band), sent, *where)
        totals = materialise(time_forward(rows, *where), f"trie-band-{band}")
        done.append(totals)
        sent = sent_up(totals)
        if band:
            shard_of = placed.where((F.col("band") == band) & ~F.col("inside")).select((F.col("depth") - 1).alias("depth"), F.col("p0").alias("k0"), F.col("p1").alias("k1"), *where).distinct()
            sent = sent.join(shard_of, KEY)
    totals = materialise(time_forward(stream(top.withColumn("inside", F.col("depth") > 0), sent)), "trie-top-totals")
    for part in done:
        totals = totals.unionByName(part)
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k0").alias("p0"), F.col("k1").alias("p1"), F.col("conv_id").alias("parent")).where("depth > 1")
    parent: Column = F.when(F.col("depth") == 1, F.lit(least)).otherwise(F.col("parent")).cast("long")  # the root's children, without a join
    named = totals.where("depth > 1").join(parents, ["depth", "p0", "p1"], "left").unionByName(totals.where("depth <= 1"), allowMissingColumns=True)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return named.join(ends(members), KEY, "left").select(
        "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("sha", nothing).alias("ends_sha256"))


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The trie of all ``conversations``, each rebuilt with the first turns of the one at its hundred."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return trie(member_rows(table, shared=6, every=100))


OP12_SQL = """
WITH RECURSIVE
bits(b, r, n) AS (
  SELECT i, CAST(i AS BIGINT), 0 FROM range(256) t(i)
  UNION ALL
  SELECT b, CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END, n + 1 FROM bits WHERE n < 8),
crc_table AS (SELECT b, r FROM bits WHERE n = 8),
convs AS (SELECT conv_id, count(*) AS n FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
crc(conv_id, s, pos, r) AS (
  SELECT conv_id, CAST(conv_id AS VARCHAR), 0, CAST(4294967295 AS BIGINT) FROM convs
  UNION ALL
  SELECT c.conv_id, c.s, c.pos + 1, xor(c.r // 256, t.r)
  FROM crc c JOIN crc_table t ON t.b = xor(c.r % 256, CAST(ascii(substr(c.s, c.pos + 1, 1)) AS BIGINT)) WHERE c.pos < length(c.s)),
plan AS (SELECT conv_id, xor(r, 4294967295) % 6 AS h, conv_id - conv_id % 100 AS head FROM crc WHERE pos = length(s)),
turns AS (
  SELECT conv_id, length(coalesce(text, '')) AS chars,
    sha256(concat(CAST(strlen(coalesce(role, '')) AS VARCHAR), ':', coalesce(role, ''), coalesce(text, ''))) AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
      sha256(concat(CAST(strlen(coalesce(role, '')) AS VARCHAR), ':', coalesce(role, ''), coalesce(text, '')))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
rebuilt AS (
  SELECT p.conv_id, row_number() OVER (PARTITION BY p.conv_id ORDER BY t.conv_id <> p.head OR t.pos >= p.h, t.pos) AS depth, t.x, t.chars
  FROM plan p JOIN turns t ON (t.conv_id = p.head AND t.pos < p.h) OR (t.conv_id = p.conv_id AND t.pos >= p.h)),
members AS (
  SELECT conv_id, depth, chars, string_agg(x, '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth) AS k FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM plan),
lengths AS (SELECT conv_id, max(depth) AS turns FROM members GROUP BY conv_id),
nodes AS (
  SELECT m.k, m.depth, min(m.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(m.chars) AS saved,
    sha256(coalesce(string_agg(CASE WHEN m.depth = l.turns THEN CAST(m.conv_id AS VARCHAR) END, ',' ORDER BY m.conv_id), '')) AS ends
  FROM members m JOIN lengths l USING (conv_id) GROUP BY m.k, m.depth),
children AS (SELECT substr(k, 1, 64 * (CAST(depth AS INTEGER) - 1)) AS k, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
below AS (SELECT DISTINCT a.k, b.k AS lower FROM members a JOIN members b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
totals AS (
  SELECT b.k, sum(CASE WHEN c.k IS NULL THEN 1 ELSE 0 END) AS leaves, sum(n.saved) AS saved
  FROM below b JOIN nodes n ON n.k = b.lower LEFT JOIN children c ON c.k = b.lower GROUP BY b.k)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs,
  CAST(coalesce(c.n, 0) AS BIGINT) AS n_children, CAST(t.leaves AS BIGINT) AS n_leaves, CAST(t.saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM nodes n JOIN totals t ON t.k = n.k LEFT JOIN children c ON c.k = n.k
LEFT JOIN nodes p ON n.depth > 0 AND p.k = substr(n.k, 1, 64 * (CAST(n.depth AS INTEGER) - 1))
"""
