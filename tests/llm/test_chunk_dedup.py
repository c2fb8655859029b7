import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import chunk_dedup as c


def brute_cuts(data):
    ends, last = [], 0
    for end in range(1, len(data) + 1):
        h = sum(int(c.GEAR[data[end - 1 - k]]) << k for k in range(min(16, end))) & 0xFFFF
        size = end - last
        fits = end == len(data) or data[end] & 0xC0 != 0x80
        if size >= c.SHORTEST and h < 1 << (16 - c.CUT_BITS) and fits or end == len(data):
            ends.append(end)
            last = end
        elif size == c.LONGEST + 1:  # seen once the cut didn't come in time
            raise AssertionError("too long for this check")
    return ends


@settings(max_examples=100, deadline=None)
@given(st.text("abc déf\n漢", max_size=400))
def test_cuts(text):
    data = text.encode()
    ends = c.cuts(data)
    assert b"".join(data[a:b] for a, b in zip([0, *ends], ends)) == data
    assert all(b - a <= c.LONGEST for a, b in zip([0, *ends], ends)) and (not data or ends[-1] == len(data))
    for e in ends:
        data[:e].decode()
    try:
        assert ends == brute_cuts(data)
    except AssertionError as e:
        if "too long" not in str(e):
            raise


def words(rng, n):
    return " ".join("".join(rng.choices("aeioubcdflmnrst", k=rng.randint(2, 9))) for _ in range(n))


def test_repeated_passages_go(spark):
    rng = random.Random(5)
    passages = [words(rng, n) for n in (51, 60, 200, 55)]
    rows, clean = [], {}
    for i in range(200):
        rows.append((i, f"{words(rng, rng.randint(5, 80))} {passages[i % 4]}{words(rng, rng.randint(3, 80))}" if i < 120 else words(rng, 150)))
        clean[i] = i >= 120
    got = {r.doc_id: r for r in c.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        r = got[i]
        again = "".join(text[a:b] for a, b in zip([0, *(s.stop for s in r.spans)], [*(s.start for s in r.spans), len(text)]))
        assert again == r.text and len(text) - len(r.text) == r.n_removed
        if clean[i] or i < 4:
            assert r.text == text
        else:
            passage = passages[i % 4]
            left = sum(1 for s in r.spans for p in range(s.start, s.stop) if text.find(passage) <= p < text.find(passage) + len(passage))
            assert left >= 0.5 * len(passage) and r.n_removed <= len(passage) + 40


def test_hardly_a_passage_is_missed():
    """51 short words or one word over and over, each in two texts that share nothing else."""
    rng, left = random.Random(7), []
    short = lambda n: " ".join("".join(rng.choices("aeioubcdflmnrst", k=rng.randint(2, 6))) for _ in range(n))
    for i in range(400):
        passage = short(51) if i % 8 else " ".join([short(1)] * 60)
        first, before = f"{short(40)} {passage} {short(40)}", short(33) + " "
        again = f"{before}{passage} {short(37)}"
        cut = c.runs(again.encode(), set(c.digests(first.encode())[1]), c.MIN_RUN)
        gone = sum(b - a for a, b in cut)
        assert all(len(before) - 12 <= a and b <= len(before) + len(passage) + 12 for a, b in cut)  # words next to it may be equal by chance
        assert gone >= 0.5 * len(passage), passage
        left.append(1 - gone / len(passage))
    assert sum(left) < 0.15 * len(left)


@settings(max_examples=200, deadline=None)
@given(st.text("ab c\n漢", max_size=200), st.text("abc d", min_size=40, max_size=300), st.text("ab c\n漢", max_size=200), st.sampled_from([20, 96]))
def test_equal_windows_have_equal_anchors(before, shared, after, min_run):
    x, y = (before + shared).encode(), (after + shared + before).encode()
    place = {x[a:b]: a for a, b in c.digests(x, min_run)[0]}
    least = [c.anchors(d, min_run) for d in (x, y)]
    assert [len(v) for v in least] == [max(0, len(d) - min_run + 1) for d in (x, y)]
    for a, b in c.digests(y, min_run)[0]:
        if (at := place.get(y[a:b])) is not None:
            assert least[0][at] == least[1][a] and least[0][at + b - a - min_run] == least[1][b - min_run]


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    owner = {}
    for i, t in sorted(rows):
        for d in c.digests(t.encode())[1]:
            owner.setdefault(d, i)
    want = {}
    for i, t in rows:
        data, last, pieces = t.encode(), 0, []
        for a, b in c.runs(data, {d for d in c.digests(data)[1] if owner[d] < i}, c.MIN_RUN):
            pieces.append(data[last:a])
            last = b
        want[i] = (b"".join(pieces) + data[last:]).decode()
    got = {r.doc_id: r.text for r in c.op8_chunk_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert got == want and any(got[i] != t for i, t in rows)


def test_edges(spark):
    rng = random.Random(6)
    long, text = words(rng, 60_000), words(rng, 90)
    rows = [(1, text, 5), (2, text, 5), (2, text, 6), (None, text, 5), (None, text, 5), (3, None, 5), (4, "", 5), (5, long, 5), (6, long[:200_000] + " new " + long[200_000:], 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    out = c.dedup(df)
    assert out.columns == ["doc_id", "text", "spans", "n_removed"]
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert sorted(t for i, t in got if i is None) == [text, text]
    assert [t for i, t in got if i == 1] == [text] and [t for i, t in got if i == 2] == ["", ""]
    assert (3, None) in got and (4, "") in got and (5, long) in got
    assert len(next(t for i, t in got if i == 6)) < 1500
    assert c.dedup(df.limit(0)).count() == 0


def test_copies_and_names(spark):
    """Whole copies lose what their windows cover; another text under the same doc_id is judged by itself; names are safe."""
    rng = random.Random(8)
    a, b, d = words(rng, 120), words(rng, 120), words(rng, 120)
    rows = [(1, a), (2, a), (3, a), (3, d), (4, b), (4, b), (5, a + " " + words(rng, 40)), (6, "short"), (7, "short"), (8, None)]
    df = spark.createDataFrame([(i, t, "id", "an", "f", "dot") for i, t in rows], "doc_id long, text string, _id string, _anchors string, foreign string, `a.b` string").repartition(3)
    out = c.dedup(df)
    assert out.columns == ["doc_id", "text", "_id", "_anchors", "foreign", "a.b", "spans", "n_removed"]
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    cut = lambda t: "".join(t[x:y] for x, y in zip([0, *(q for _, q in c.runs(t.encode(), c.Everything(), c.MIN_RUN))], [*(p for p, _ in c.runs(t.encode(), c.Everything(), c.MIN_RUN)), len(t)]))
    assert [t for i, t in got if i == 1] == [a] and [t for i, t in got if i == 2] == [cut(a)]
    assert [t for i, t in got if i == 4] == [b, b] and [t for i, t in got if i in (6, 7)] == ["short", "short"]
    three = [t for i, t in got if i == 3]
    assert d in three and min(map(len, three)) < 30
    assert {i for (i,) in c.copies(df.select("doc_id", "text")).collect()} == {2, 7}
    assert {(r._id, r._anchors, r.foreign, r["a.b"]) for r in out.collect()} == {("id", "an", "f", "dot")}
