import hashlib
import random
import zlib

from tessera.llm import prefix_trie as p

KIND = "conv_id long, turn long, role string, text string"


def brute(rows, shared=6, every=100):
    """By dictionaries over whole prefixes."""
    convs = {}
    order = lambda r: (r[1] is not None, r[1] or 0, hashlib.sha256(f"{len((r[2] or '').encode())}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest())
    for r in sorted((r for r in rows if r[0] is not None), key=order):
        convs.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % shared
        rebuilt[c] = tuple(convs.get(c - (c % every if c >= 0 else -(-c % every)), [])[:h] + own[h:])
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = []
    for k, inside in members.items():
        below = [x for x in members if x[: len(k)] == k]
        parents = {x[:-1] for x in members if x}
        ends = sorted(c for c in inside if rebuilt[c] == k)
        out.append((min(inside), len(k), min(members[k[:-1]]) if k else None, len(inside), sum(1 for x in members if x and x[:-1] == k),
                    sum(x not in parents for x in below), sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def some(rng, n, turns, words):
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, turns)):
            rows.append((c, t, rng.choice(["user", "bot"]), rng.choice(words)))
    return rows


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = some(rng, 330, 8, ["a", "bé", "", "long text"])
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, KIND).repartition(5)
    assert got(p.trie(p.member_rows(df, 6))) == brute(rows)
    assert got(p.trie(p.member_rows(df))) == brute(rows, 1)


def test_long_conversations_over_many_tasks(spark, monkeypatch):
    """A conversation of most of the rows, shards of several bands, copies of one conversation."""
    monkeypatch.setattr(p, "STRIDE", 7)
    monkeypatch.setattr(p, "BAND", 5)
    monkeypatch.setattr(p, "FEW", 3)
    monkeypatch.setattr(p, "BROADCAST_NODES", 0)
    rng = random.Random(4)
    long = [("user", str(rng.randint(0, 9))) for _ in range(400)]
    rows = [(7, i, *x) for i, x in enumerate(long)] + [(8, i, *x) for i, x in enumerate(long[:150])] + [(9, i, *x) for i, x in enumerate(long[:60] + [("bot", "x")] * 30)]
    rows += [(c, i, *x) for c in range(20, 40) for i, x in enumerate(long[:12])]
    rows += some(rng, 6, 4, ["0", "1"])
    df = spark.createDataFrame(rows, KIND).repartition(6)
    assert got(p.trie(p.member_rows(df))) == brute(rows, 1)
    assert got(p.trie(p.member_rows(df, 6))) == brute(rows)


def test_queue_spills():
    rng = random.Random(5)
    entries = [(-rng.randint(0, 5), rng.randint(0, 3), rng.randint(0, 3), rng.randint(0, 9), 1, 1) for _ in range(500)]
    queue = p.Pending(most=40)
    for e in entries:
        queue.push(e)
    assert len(queue.runs) > 5
    for key in sorted({e[:3] for e in entries}):
        assert sorted(queue.take(key)) == sorted(e for e in entries if e[:3] == key)
    assert not queue.heap and not queue.runs


def test_edges(spark, tmp_path):
    rows = [(None, 0, "user", "x"), (100, None, None, None), (100, 0, "user", None), (100, 0, "user", None), (101, 5, "user", "y"), (-3, 0, "", ""), (250, 1, "user", "w" * 100_000), (250, 1, "bot", "z"), (251, 3, "a", "b")]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], KIND + ", depth string, `k.0` int")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    assert got(p.op12_prefix_trie(spark, str(tmp_path))) == brute(rows)
    assert p.trie(p.member_rows(df.limit(0), 6)).count() == 0
    assert p.trie(p.member_rows(df.where("conv_id is null"), 6)).count() == 0


def test_hot_node_is_hashed_in_parts(spark, monkeypatch):
    rows = [(c, 0, "user", "same") for c in range(3000)]
    df = spark.createDataFrame(rows, KIND).repartition(8)
    out = p.trie(p.member_rows(df)).collect()
    want = hashlib.sha256(",".join(map(str, range(3000))).encode()).hexdigest()
    assert sorted((r.depth, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in out) == [(0, 3000, 1, 1, 2999 * 4), (1, 3000, 0, 1, 2999 * 4)]
    assert {r.ends_sha256 for r in out if r.depth} == {want}
