"""Distributed table profile.

Plan shape (per SURVEY §3 "Entry 2"):

* **value counts** (``operators.keys``) — every cell as a short typed key, stacked
  into ``(col_idx, key)`` and counted with one ``groupBy``.  Map-side partial
  aggregation collapses hot values before the shuffle, so a value holding a third of
  all rows costs one row per map task, and no text is part of an exchange.  From this
  table come missing counts, distinct counts, top values and modes.
* **moments** — one narrow-to-wide ``agg`` for counts/means/σ/min/max.
* **duplicates** — ``groupBy`` a 16-byte digest of the row; partial aggregation again
  absorbs heavily repeated rows.

Every result is a small DataFrame (≤ a few rows per column); nothing is
collected on the driver except where a caller asks for a Python value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.keys import heavy_hitters, key_counts, row_digest
from tessera.session import materialise
from tessera.functions.scalars import pct2
from tessera.functions.types import (
    qcol,
    CATEGORICAL,
    NUMERIC,
    as_text,
    column_class,
    is_fractional,
    missing_mask,
    normalized,
)

COMPACT_TEXT_BYTES = 64


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _lookup(values: list, idx: Column) -> Column:
    """``values[idx]`` for a literal list (no join; list size = number of columns)."""
    if not values:
        return F.lit(None)
    return F.element_at(F.array(*[F.lit(v) for v in values]), idx + 1)


def schema_frame(df: DataFrame) -> DataFrame:
    """One row per column: position, name, Spark type, class (schema walk, no job)."""
    rows = [(i, f.name, f.dataType.simpleString(), column_class(f.dataType)) for i, f in enumerate(df.schema.fields)]
    schema = "column_idx int, column_name string, spark_type string, column_class string"
    return df.sparkSession.createDataFrame(rows, schema)


def column_types(df: DataFrame) -> DataFrame:
    return schema_frame(df).select("column_idx", "column_name", "column_class")


def column_type_distribution(df: DataFrame) -> DataFrame:
    classes = [column_class(f.dataType) for f in df.schema.fields]
    spark = df.sparkSession
    return spark.createDataFrame(
        [(classes.count(NUMERIC), classes.count(CATEGORICAL), len(classes))],
        "numeric long, categorical long, total long",
    )


def frequency_table(df: DataFrame, columns: list[str] | None = None, compact: bool = False) -> DataFrame:
    """``(col_idx, value, cnt)`` for every (column, text value) including the missing value (null).

    ``compact=True`` (for counting only): text longer than ``COMPACT_TEXT_BYTES``
    is keyed by its SHA-256 in a separate column ``h`` (``value`` null), so
    long documents are not shuffled in full just to be counted.
    """
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    pos = {f.name: i for i, f in enumerate(df.schema.fields)}
    cells = []
    for f in fields:
        text = as_text(f.name, f.dataType)
        if compact and column_class(f.dataType) == CATEGORICAL:
            long = F.octet_length(text) > F.lit(COMPACT_TEXT_BYTES)
            value, h = F.when(~long, text), F.when(long, F.unhex(F.sha2(text, 256)))
        else:
            value, h = text, F.lit(None).cast("binary")
        cells.append(F.struct(F.lit(pos[f.name]).alias("col_idx"), value.alias("value"), h.alias("h")))
    stacked = df.select(F.explode(F.array(*cells)).alias("cell")).select("cell.col_idx", "cell.value", "cell.h")
    keys = ["col_idx", "value", "h"] if compact else ["col_idx", "value"]
    return stacked.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt"))


def _per_column_counts(df: DataFrame, freq: DataFrame) -> DataFrame:
    present = F.coalesce(*[F.when(F.col(c).isNotNull(), True) for c in ("value", "l", "d", "h") if c in freq.columns], F.lit(False))
    return freq.groupBy("col_idx").agg(
        F.sum("cnt").alias("rows"),
        F.coalesce(F.sum(F.when(~present, F.col("cnt"))), F.lit(0)).alias("missing"),
        F.count_if(present).alias("distinct_count"),
    )


def column_profile(df: DataFrame, freq: DataFrame | None = None) -> DataFrame:
    """Flagship: ``(column_idx, column_name, column_class, rows, missing, missing_pct, distinct_count)``."""
    freq = key_counts(df) if freq is None else freq
    counts = _per_column_counts(df, freq)
    names = [f.name for f in df.schema.fields]
    classes = [column_class(f.dataType) for f in df.schema.fields]
    # a zero-row table has an empty frequency table: the schema frame keeps one row per column
    sf = schema_frame(df).select("column_idx")
    out = sf.join(F.broadcast(counts.withColumnRenamed("col_idx", "column_idx")), "column_idx", "left")
    rows = F.coalesce(F.col("rows"), F.lit(0)).cast("long")
    missing = F.coalesce(F.col("missing"), F.lit(0)).cast("long")
    return out.select(
        F.col("column_idx"),
        _lookup(names, F.col("column_idx")).alias("column_name"),
        _lookup(classes, F.col("column_idx")).alias("column_class"),
        rows.alias("rows"),
        missing.alias("missing"),
        pct2(missing, rows).alias("missing_pct"),
        F.coalesce(F.col("distinct_count"), F.lit(0)).cast("long").alias("distinct_count"),
    )


def missing_by_column(df: DataFrame) -> DataFrame:
    """Missing cells per column in column order (one ``agg``, no shuffle of data)."""
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("__rows")]
    aggs += [F.count_if(missing_mask(f.name, f.dataType)).alias(f"m{i}") for i, f in enumerate(fields)]
    one = df.agg(*aggs)
    stacked = F.explode(F.array(*[
        F.struct(F.lit(i).alias("column_idx"), F.lit(f.name).alias("column_name"), F.col(f"m{i}").alias("missing"))
        for i, f in enumerate(fields)
    ])).alias("m")
    return one.select(F.col("__rows").alias("rows"), stacked).select(
        "m.column_idx", "m.column_name", F.col("m.missing").cast("long").alias("missing"),
        pct2(F.col("m.missing"), F.col("rows")).alias("missing_pct"),
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """``(rows, distinct_rows, duplicate_rows)``; null = null and NaN = NaN as in pandas.

    Rows meet by their 16-byte digest, whatever their width; partial aggregation absorbs hot rows.
    """
    groups = df.select(row_digest(df).alias("row")).groupBy("row").agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows"),
        F.count(F.lit(1)).cast("long").alias("distinct_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"),
    )


def table_profile(df: DataFrame, dups: DataFrame | None = None) -> DataFrame:
    """One row: rows, cols, missing cells, completeness %, quality score, duplicates, class counts."""
    dups = duplicate_rows(df) if dups is None else dups
    ncols = len(df.columns)
    classes = [column_class(f.dataType) for f in df.schema.fields]
    missing = [F.count_if(missing_mask(f.name, f.dataType)) for f in df.schema.fields]
    per = df.agg(F.count(F.lit(1)).alias("rows"), sum(missing, F.lit(0)).cast("long").alias("total_missing"))
    cells = F.col("rows") * F.lit(ncols)
    complete = pct2(cells - F.col("total_missing"), cells)
    # two one-row aggregates side by side: union + max, no join
    both = per.select("rows", "total_missing", F.lit(None).cast("long").alias("duplicate_rows")).unionByName(
        dups.select(F.lit(None).cast("long").alias("rows"), F.lit(None).cast("long").alias("total_missing"),
                    "duplicate_rows")).agg(*[F.max(c).alias(c) for c in ("rows", "total_missing", "duplicate_rows")])
    return both.select(
        "rows",
        F.lit(ncols).cast("long").alias("cols"),
        "total_missing",
        complete.alias("completeness_pct"),
        F.coalesce(complete, F.lit(100.0)).alias("quality_score"),
        "duplicate_rows",
        F.lit(classes.count(NUMERIC)).cast("long").alias("numeric_cols"),
        F.lit(classes.count(CATEGORICAL)).cast("long").alias("categorical_cols"),
    )


def quality_breakdown(df: DataFrame) -> DataFrame:
    """Three rows: complete cells, missing cells, duplicate rows."""
    t = table_profile(df)
    return t.select(F.explode(F.array(
        F.struct(F.lit(0).alias("idx"), F.lit("complete_cells").alias("category"),
                 (F.col("rows") * F.col("cols") - F.col("total_missing")).alias("value")),
        F.struct(F.lit(1).alias("idx"), F.lit("missing_cells").alias("category"),
                 F.col("total_missing").alias("value")),
        F.struct(F.lit(2).alias("idx"), F.lit("duplicate_rows").alias("category"),
                 F.col("duplicate_rows").alias("value")),
    )).alias("q")).select("q.idx", "q.category", F.col("q.value").cast("long").alias("value"))


def distinct_counts(df: DataFrame) -> DataFrame:
    return column_profile(df).select("column_idx", "column_name", "distinct_count")


def top_values(df: DataFrame, k: int = 10, columns: list[str] | None = None,
               counts: DataFrame | None = None) -> DataFrame:
    """Top-k non-missing values per column by count (tie → smaller value first); see ``operators.keys``."""
    if columns is None:
        columns = [f.name for f in df.schema.fields if column_class(f.dataType) == CATEGORICAL]
    names = [f.name for f in df.schema.fields]
    if not columns:
        return df.sparkSession.createDataFrame([], "column_idx int, column_name string, rank int, value string, count long")
    counts = materialise(key_counts(df, columns, head=True), "value-counts") if counts is None else counts
    found = heavy_hitters(df, counts.where(F.col("col_idx").isin([names.index(c) for c in columns])), k)
    return found.select(
        F.col("col_idx").alias("column_idx"),
        _lookup(names, F.col("col_idx")).alias("column_name"),
        F.col("rank").cast("int").alias("rank"),
        F.col("value"),
        F.col("cnt").cast("long").alias("count"),
    )


def describe_categorical(df: DataFrame, columns: list[str] | None = None,
                         counts: DataFrame | None = None) -> DataFrame:
    """count, unique, top, freq per categorical column (top tie → smallest value)."""
    if columns is None:
        columns = [f.name for f in df.schema.fields if column_class(f.dataType) == CATEGORICAL]
    names = [f.name for f in df.schema.fields]
    if not columns:
        return df.sparkSession.createDataFrame([], "column_idx int, column_name string, count long, unique long, top string, freq long")
    counts = materialise(key_counts(df, columns, head=True), "value-counts") if counts is None else counts
    totals = _per_column_counts(df, counts.where(F.col("col_idx").isin([names.index(c) for c in columns])))
    top = top_values(df, 1, columns, counts).select("column_idx", "value", "count")
    return (
        totals.withColumnRenamed("col_idx", "column_idx")
        .join(top, "column_idx", "left")
        .select(
            "column_idx",
            _lookup(names, F.col("column_idx")).alias("column_name"),
            (F.col("rows") - F.col("missing")).cast("long").alias("count"),
            F.col("distinct_count").cast("long").alias("unique"),
            F.col("value").alias("top"),
            F.col("count").cast("long").alias("freq"),
        )
    )


def describe_numeric(df: DataFrame, columns: list[str] | None = None, exact: bool = True,
                     accuracy: int = 100000) -> DataFrame:
    """count, mean, std (n-1), min, 25/50/75 % (linear), max per numeric column.

    ``exact=True`` computes exact quantiles by a range-partitioned rank pass
    (``operators.quantiles``) — no task ever holds a whole column;
    ``exact=False`` uses ``percentile_approx`` (one pass, bounded sketch).
    """
    from tessera.operators.quantiles import exact_quantiles

    if columns is None:
        columns = [f.name for f in df.schema.fields if column_class(f.dataType) == NUMERIC]
    types = {f.name: f.dataType for f in df.schema.fields}
    names = [f.name for f in df.schema.fields]
    schema = ("column_idx int, column_name string, count long, mean double, std double, min double, "
              "p25 double, p50 double, p75 double, max double")
    if not columns:
        return df.sparkSession.createDataFrame([], schema)
    aggs = []
    for i, c in enumerate(columns):
        v = normalized(c, types[c]).cast("double")
        fields = [F.lit(names.index(c)).alias("column_idx"), F.lit(c).alias("column_name"),
                  F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
                  F.min(v).alias("min"), F.max(v).alias("max")]
        if not exact:
            fields.append(F.percentile_approx(v, [0.25, 0.5, 0.75], accuracy).alias("q"))
        aggs.append(F.struct(*fields).alias(f"s{i}"))
    one = df.agg(*aggs)
    base = one.select(F.explode(F.array(*[F.col(f"s{i}") for i in range(len(columns))])).alias("s")).select("s.*")
    if exact:
        q = exact_quantiles(df, columns).groupBy("column_idx").pivot("prob_idx", [0, 1, 2]).agg(F.first("value"))
        q = q.select("column_idx", F.col("0").alias("p25"), F.col("1").alias("p50"), F.col("2").alias("p75"))
        base = base.join(q, "column_idx", "left")
    else:
        base = base.select("*", F.col("q")[0].cast("double").alias("p25"), F.col("q")[1].cast("double").alias("p50"),
                           F.col("q")[2].cast("double").alias("p75"))
    return base.select("column_idx", "column_name", F.col("count").cast("long").alias("count"), "mean", "std", "min",
                       "p25", "p50", "p75", "max")


def logical_bytes(df: DataFrame) -> DataFrame:
    """Bytes per column: fixed width × non-null rows, or UTF-8 length for text/binary."""
    fixed = {
        T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4,
        T.DoubleType: 8, T.BooleanType: 1, T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8,
    }
    aggs = []
    for i, f in enumerate(df.schema.fields):
        c = qcol(f.name)
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            e = F.coalesce(F.sum(F.octet_length(c)), F.lit(0))
        elif type(f.dataType) in fixed:
            e = F.count(c) * F.lit(fixed[type(f.dataType)])
        elif isinstance(f.dataType, T.DecimalType):
            e = F.count(c) * F.lit(16)
        else:
            e = F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(c)))), F.lit(0))
        aggs.append(F.struct(F.lit(i).alias("column_idx"), F.lit(f.name).alias("column_name"),
                             e.cast("long").alias("bytes")).alias(f"b{i}"))
    one = df.agg(*aggs)
    return one.select(F.explode(F.array(*[F.col(f"b{i}") for i in range(len(aggs))])).alias("b")).select("b.*")


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop columns whose every cell is missing (one ``agg`` of counts)."""
    fields = df.schema.fields
    if not fields:
        return df
    r = df.agg(*[F.count_if(~missing_mask(f.name, f.dataType)).alias(f"c{i}") for i, f in enumerate(fields)]).first()
    keep = [_q(f.name) for i, f in enumerate(fields) if r[f"c{i}"] > 0]
    return df.select(*keep)


def profile(df: DataFrame, corr_max_cols: int | None = None) -> dict[str, DataFrame]:
    """Full bundle over all columns; the table of value counts is written once to the shared folder and shared."""
    from tessera.operators.correlation import correlation_matrix
    from tessera.operators.sampling import numeric_sample

    counts = materialise(key_counts(df, head=True), "profile-counts")
    dups = duplicate_rows(df)
    return {
        "table": table_profile(df, dups=dups),
        "schema": schema_frame(df),
        "type_distribution": column_type_distribution(df),
        "columns": column_profile(df, counts),
        "top_values": top_values(df, 10, None, counts),
        "describe_categorical": describe_categorical(df, counts=counts),
        "quality_breakdown": quality_breakdown(df),
        "samples": numeric_sample(df),
        "correlation": correlation_matrix(df, max_cols=corr_max_cols),
        "describe_numeric": describe_numeric(df),
        "logical_bytes": logical_bytes(df),
    }
