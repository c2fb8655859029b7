"""Correlation tile by tile: the same numbers for any block and tile, in bounded memory."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tessera.operators import correlation as c


def _brute(x):
    k = x.shape[1]
    out = {}
    for i in range(k):
        for j in range(k):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            a, b = x[both, i], x[both, j]
            out[i, j] = None if len(a) < 2 or a.std() == 0 or b.std() == 0 else float(np.corrcoef(a, b)[0, 1])
    return out


def test_blocks_and_tiles_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 23)) + rng.normal(size=(90, 1))
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 5] = 3.0
    x[:, 6] = np.nan
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"c{i} double" for i in range(23))).repartition(3)
    want = _brute(x)
    for block, tile, rows in ((512, 128, 2048), (10, 4, 7), (7, 7, 50), (1, 1, 90)):
        for name, value in (("BLOCK", block), ("TILE", tile), ("ROWS", rows)):
            monkeypatch.setattr(c, name, value)
        got = {(r.i, r.j): r.corr for r in c.correlation_matrix(df).collect()}
        assert got.keys() == want.keys()
        for at, r in want.items():
            assert (got[at] is None) == (r is None) and (r is None or abs(got[at] - r) < 1e-9), (at, block)


def test_a_task_of_two_thousand_columns_is_bounded():
    """A pair of blocks and the adding of tiles stay below 500 MB, whatever the number of columns."""
    left, right = list(range(c.BLOCK)), list(range(c.BLOCK, 2 * c.BLOCK))
    batch = pa.RecordBatch.from_arrays([pa.array(np.random.default_rng(i).normal(size=4000)) for i in range(2 * c.BLOCK)], names=[str(i) for i in range(2 * c.BLOCK)])
    tracemalloc.start()
    tiles = list(c.block_partials(left, right, c.TILE, c.ROWS)(iter([batch, batch])))
    assert tracemalloc.get_traced_memory()[1] < 500e6
    tracemalloc.stop()
    assert len(tiles) == (c.BLOCK // c.TILE) ** 2
    cells = sum(b.num_rows for b in c.add_tiles(iter(sorted([*tiles, *tiles], key=lambda t: (t.column("a")[0].as_py(), t.column("b")[0].as_py())))))
    assert cells == c.BLOCK**2
