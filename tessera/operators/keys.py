"""Cells and rows by short keys: exact counting without text in an exchange.

* :func:`key_counts` counts the cells of many columns in one shuffle.  A cell's key is
  typed: whole numbers, booleans, dates, times and decimals of up to 18 digits are a
  long, floating numbers a double, anything else at most 16 bytes — short text
  itself, longer text the first half of its SHA-256.
* :func:`heavy_hitters` finds the k most frequent values of each column by the
  histogram of those counts; ties at the k-th count are told by the first bytes of the
  text, further bytes being looked at only while too many are alike.  Only winners
  fetch their text.
* :func:`row_digest` is 16 bytes for a whole row (null = null, NaN = NaN, −0 = 0).

Two texts, or two rows, meet in one key with a chance of some n² / 2^129.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.types import as_text, is_fractional, normalized
from tessera.session import materialise

#: Bytes of a text that go with its count; values alike in all bytes seen so far that are fetched at once.
HEAD, ALIKE = 32, 10_000


def digest(value: Column) -> Column:
    """16 bytes for a text or binary value."""
    return F.unhex(F.substring(F.sha2(value, 256), 1, 32))


def key_lanes(name: str, dtype: T.DataType) -> tuple[Column, Column, Column]:
    """(long, double, binary): the lane of the cell's type holds its key; all null for a missing cell."""
    whole, real, other = F.lit(None).cast("long"), F.lit(None).cast("double"), F.lit(None).cast("binary")
    c = normalized(name, dtype)
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        whole = c.cast("long")
    elif isinstance(dtype, T.DateType):
        whole = F.unix_date(c).cast("long")
    elif isinstance(dtype, T.TimestampType):
        whole = F.unix_micros(c)
    elif isinstance(dtype, T.DecimalType) and dtype.precision <= 18:
        whole = (c * F.lit(10 ** dtype.scale).cast(T.DecimalType(dtype.scale + 1, 0))).cast("long")
    elif is_fractional(dtype) or isinstance(dtype, T.DayTimeIntervalType):
        real = c.cast("double")
    else:
        text = as_text(name, dtype)
        other = F.when(F.octet_length(text) < 16, text.cast("binary")).otherwise(digest(text))
    return whole, real, other


def key_counts(df: DataFrame, columns: list[str] | None = None, head: bool = False) -> DataFrame:
    """``(col_idx, l, d, h, cnt)`` for each distinct cell of each column, the missing one included (no key).

    With ``head`` also ``head`` (the text's first bytes) and ``size`` (its bytes); one shuffle, at most some 60 bytes a row.
    """
    cells = []
    for i, f in enumerate(df.schema.fields):
        if columns is not None and f.name not in columns:
            continue
        whole, real, other = key_lanes(f.name, f.dataType)
        text = as_text(f.name, f.dataType).cast("binary")
        more = [F.substring(text, 1, HEAD).alias("head"), F.octet_length(text).alias("size")] if head else []
        cells.append(F.struct(F.lit(i).alias("col_idx"), whole.alias("l"), real.alias("d"), other.alias("h"), *more))
    stacked = df.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")
    return stacked.groupBy("col_idx", "l", "d", "h").agg(F.count(F.lit(1)).alias("cnt"), *[F.min(c).alias(c) for c in ("head", "size") if head])


def present() -> Column:
    return F.col("l").isNotNull() | F.col("d").isNotNull() | F.col("h").isNotNull()


def with_values(df: DataFrame, rows: DataFrame, long: list[int] | None = None) -> DataFrame:
    """Rows of :func:`key_counts` (with heads; a bounded number of them) plus ``value``, the cell's whole text.

    Texts longer than the head are looked up in ``df`` by their key.  A hash join keeps the texts where they are, so one
    for each task and key is moved.  ``long``: the columns that may have such texts, if known.
    """
    if long is None:
        long = [r["col_idx"] for r in rows.where(F.col("size") > HEAD).select("col_idx").distinct().collect()]
    short = F.when(F.col("size") <= HEAD, F.decode("head", "UTF-8"))
    if not long:
        return rows.withColumn("value", short)
    cells = []
    for i in long:
        f = df.schema.fields[i]
        cells.append(F.struct(F.lit(i).alias("col_idx"), key_lanes(f.name, f.dataType)[2].alias("h"), as_text(f.name, f.dataType).alias("text")))
    wanted = rows.where(F.col("size") > HEAD).select("col_idx", "h")
    found = df.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*").join(F.broadcast(wanted), ["col_idx", "h"]).groupBy("col_idx", "h").agg(F.min("text").alias("text"))
    return rows.join(found, ["col_idx", "h"], "left").withColumn("value", F.coalesce(short, "text")).drop("text")


def per_column(values: dict[int, object], kind: str) -> Column:
    """The value for ``col_idx`` of a small map (one entry a column); null without an entry."""
    if not values:
        return F.lit(None).cast(kind)
    return F.try_element_at(F.map_from_arrays(F.array(*[F.lit(i) for i in values]), F.array(*[F.lit(v).cast(kind) for v in values.values()])), F.col("col_idx"))


def heavy_hitters(df: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """``(col_idx, rank, value, cnt)``: the k most frequent present values of each column (tie → smaller text first).

    ``counts``: a written :func:`key_counts` with heads.  The histogram of the counts (at
    most some √(2n) rows a column) gives the k-th count and how many ties are needed at it.
    """
    counts = counts.where("head IS NOT NULL")
    upto = F.sum("n").over(Window.partitionBy("col_idx").orderBy(F.col("cnt").desc()))
    histogram = counts.groupBy("col_idx", "cnt").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size")).withColumn("before", upto - F.col("n"))
    cut = histogram.where(F.col("before") < k).groupBy("col_idx").agg(F.min(F.struct("cnt", "before", "n")).alias("c"), F.max("size").alias("size")).collect()  # a row a column
    least, best = {r["col_idx"]: r["c"]["cnt"] for r in cut}, Window.partitionBy("col_idx").orderBy(F.col("cnt").desc(), "value")
    long = [r["col_idx"] for r in cut if r["size"] > HEAD]
    crowded = [r["col_idx"] for r in cut if r["c"]["n"] > ALIKE]
    rows = counts.where(F.col("cnt") >= per_column({i: v for i, v in least.items() if i not in crowded}, "long"))
    if crowded:
        rows = rows.unionByName(_told_apart(df, counts.where(F.col("col_idx").isin(crowded)), k, least, {r["col_idx"]: k - r["c"]["before"] for r in cut}))
    return with_values(df, rows, long).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("col_idx", "rank", "value", "cnt")


def _told_apart(df: DataFrame, counts: DataFrame, k: int, least: dict[int, int], wanted: dict[int, int]) -> DataFrame:
    """The values above the k-th count, and of the many at it at most some ``ALIKE`` of the smallest."""
    sure = counts.where(F.col("cnt") > per_column(least, "long"))
    ties = counts.where(F.col("cnt") == per_column(least, "long")).withColumn("part", F.col("head"))
    chosen, seen = [sure], HEAD
    while True:
        rank = F.rank().over(Window.partitionBy("col_idx").orderBy("part"))
        ties = materialise(ties.withColumn("r", rank).where(F.col("r") <= k).where(F.col("r") <= per_column(wanted, "int")).drop("r"), "heavy-ties")
        last = ties.groupBy("col_idx", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("col_idx").agg(F.max(F.struct("part", "n")).alias("m")).collect()  # a row a column
        alike = {r["col_idx"]: r["m"]["part"] for r in last if r["m"]["n"] > ALIKE}
        if not alike:
            chosen.append(ties.drop("part"))
            break
        # too many values of a column share all bytes seen: those before them stay, they are told by further bytes
        at_end = F.col("part") == per_column(alike, "binary")
        chosen.append(ties.where(~F.coalesce(at_end, F.lit(False))).drop("part"))
        taken = {r["col_idx"]: r["n"] for r in chosen[-1].groupBy("col_idx").agg(F.count(F.lit(1)).alias("n")).collect()}
        wanted = {i: wanted[i] - taken.get(i, 0) for i in alike}
        rest = ties.where(at_end).drop("part")
        fields = df.schema.fields
        cells = [F.struct(F.lit(i).alias("col_idx"), key_lanes(fields[i].name, fields[i].dataType)[2].alias("h"), F.substring(as_text(fields[i].name, fields[i].dataType).cast("binary"), seen + 1, seen).alias("part")) for i in alike]
        parts = df.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*").where("h IS NOT NULL").groupBy("col_idx", "h").agg(F.min("part").alias("part"))
        ties = rest.join(parts, ["col_idx", "h"])
        seen *= 2
    rows = chosen[0]
    for more in chosen[1:]:
        rows = rows.unionByName(more)
    return rows


def row_digest(df: DataFrame) -> Column:
    """16 bytes for a whole row: two 64-bit hashes of its cells, in either order, each begun with what is missing.

    The hashes are fast, not cryptographic: rows that nobody chose to collide do so with a chance of some n² / 2^129.
    """
    cells, gone = [], []
    for f in df.schema.fields:
        plain = isinstance(f.dataType, (T.StringType, T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.BinaryType))
        cells.append(normalized(f.name, f.dataType) if plain else as_text(f.name, f.dataType))
        gone.append(F.when(cells[-1].isNull(), "1").otherwise("0"))  # a null leaves a hash as it is
    mask = F.concat(*gone) if gone else F.lit("")
    return F.struct(F.xxhash64(mask, *cells).alias("a"), F.xxhash64(F.lit(7), mask, *reversed(cells)).alias("b"))
