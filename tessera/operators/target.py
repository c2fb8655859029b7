"""Target column guess, problem-type inference, target analysis and config validation.

All statistics come from one distributed job (the frequency-table profile,
or a single ``agg``); only one small row per column reaches the driver,
where the (column-order dependent) rules are applied.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.scalars import pct2, whole_number
from tessera.functions.types import qcol, CATEGORICAL, column_class, is_loose_numeric, missing_mask, normalized
from tessera.operators.keys import key_counts, key_lanes, present
from tessera.operators.profile import column_profile

# fixed values: exact (case-insensitive) target-name matches
TARGET_NAMES = ("target", "label", "class", "y", "output", "prediction", "outcome", "diagnosis")
# fixed values: substring patterns of the interactive preselect
TARGET_SUBSTRINGS = ("target", "class", "label", "y", "output", "prediction", "outcome")
# fixed values: accepted problem types
PROBLEM_TYPES = ("classification", "regression", "binary", "multiclass")
MIN_TRAIN_ROWS = 10
# fixed value: a number with at most so many distinct values can be a target
FEW = 10
_WHOLE = ("byte", "short", "integer", "long", "boolean", "date", "timestamp")


def problem_type_rule(loose_numeric: bool, unique: int) -> str:
    """Four-way type: numeric 2 → binary, 3..19 → multiclass, else regression; text 2 → binary else multiclass."""
    if loose_numeric:
        if unique == 2:
            return "binary"
        if 2 < unique < 20:
            return "multiclass"
        return "regression"
    return "binary" if unique == 2 else "multiclass"


def problem_type_col(loose_numeric, unique):
    u = F.col(unique) if isinstance(unique, str) else unique
    ln = F.col(loose_numeric) if isinstance(loose_numeric, str) else loose_numeric
    return (F.when(ln & (u == 2), "binary").when(ln & (u > 2) & (u < 20), "multiclass").when(ln, "regression")
            .when(u == 2, "binary").otherwise("multiclass"))


def family(problem_type: str) -> str:
    """binary/multiclass/classification → classification; anything else → regression."""
    return "classification" if problem_type in ("binary", "multiclass", "classification") else "regression"


@dataclass(frozen=True)
class ColumnStats:
    idx: int
    name: str
    is_text: bool
    loose_numeric: bool
    present: int
    unique: int


def column_stats(df: DataFrame, columns: list[str] | None = None) -> list[ColumnStats]:
    """Per-column present/distinct counts from one frequency-table job (≤ one row per column collected)."""
    prof = column_profile(df, key_counts(df, columns))
    rows = {r["column_idx"]: r for r in prof.collect()}
    out = []
    for i, f in enumerate(df.schema.fields):
        if columns is not None and f.name not in columns:
            continue
        r = rows[i]
        out.append(ColumnStats(i, f.name, column_class(f.dataType) == CATEGORICAL, is_loose_numeric(f.dataType),
                               r["rows"] - r["missing"], r["distinct_count"]))
    return out


def choose_target(stats: list[ColumnStats]) -> ColumnStats:
    """Name match; else first text or ≤10-distinct column; else the last column (empties ignored)."""
    kept = [s for s in stats if s.present > 0]
    if not kept:
        raise ValueError("All columns are empty")
    named = [s for s in kept if isinstance(s.name, str) and s.name.lower() in TARGET_NAMES]
    if named:
        return named[0]
    loose = [s for s in kept if s.is_text or s.unique <= FEW]
    return loose[0] if loose else kept[-1]


def detect_target(df: DataFrame) -> tuple[str, str]:
    """``(target, problem_type)``; with a name match only the matched columns are profiled."""
    named = [c for c in df.columns if isinstance(c, str) and c.lower() in TARGET_NAMES]
    stats = column_stats(df, named) if named else None
    if not stats or all(s.present == 0 for s in stats):
        stats = column_stats(df)
    t = choose_target(stats)
    return t.name, problem_type_rule(t.loose_numeric, t.unique)


@dataclass(frozen=True)
class _Open:
    """What some rows leave open: the first named column with a value, numbers that may have few values, the first text with a value."""

    few: tuple[int, ...] = ()
    sure: int | None = None
    named: int | None = None
    everything: bool = False


def _head(tables: list[DataFrame], rows: int) -> list[dict[int, int]]:
    """table -> column -> distinct values in some rows (1 for a text with a value): a limit of short cells a table, all at once."""

    def one(df: DataFrame) -> dict[int, int]:
        cells = []
        for i, f in enumerate(df.schema.fields):
            whole, real, _ = key_lanes(f.name, f.dataType)
            text = column_class(f.dataType) == CATEGORICAL
            cells.append((F.when(~missing_mask(f.name, f.dataType), True) if text else F.coalesce(whole.cast("string"), real.cast("string"), F.when(~missing_mask(f.name, f.dataType), ""))).alias(f"c{i}"))
        head = df.select(*cells).limit(rows).toArrow()
        found = {i: pc.count_distinct(head.column(i)).as_py() for i in range(head.num_columns)}
        return {i: n for i, n in found.items() if n}

    with ThreadPoolExecutor(8) as pool:
        return list(pool.map(one, tables))


def _left_open(df: DataFrame, values: dict[int, int]) -> _Open:
    """The columns that the target rule has to count over all rows.

    Some rows settle most columns for good: a column that has a value there has
    one, and a column with more than 10 values there has more than 10.  So a
    first named column with a value is the target, and else nothing behind the
    first text column with a value can be chosen, nor a number with more than 10
    values.  Whatever the rows leave open is counted in full.
    """
    fields = df.schema.fields
    named = [i for i, f in enumerate(fields) if f.name.lower() in TARGET_NAMES]
    if named and values.get(named[0]):
        return _Open(named=named[0])
    text = [column_class(f.dataType) == CATEGORICAL for f in fields]
    sure = next((i for i in range(len(fields)) if text[i] and values.get(i)), None)
    if named or sure is None:
        return _Open(everything=True)
    lanes = [column_class(f.dataType) != CATEGORICAL for f in fields]
    return _Open(few=tuple(i for i in range(sure) if text[i] or (lanes[i] and values.get(i, 0) <= FEW)), sure=sure)


def bounded_sets(df: DataFrame, columns: list[int], most: int = FEW + 1) -> DataFrame:
    """``(i, l, d, h)``: the distinct values of each column, or at least ``most`` of them.

    A task keeps at most ``most`` values of a column and looks no further at one that has them, so however
    many values a column has, ``most`` a task are sent.
    """
    fields = df.schema.fields
    lanes = [key_lanes(fields[i].name, fields[i].dataType) for i in columns]
    kinds = ["l" if fields[i].dataType.typeName() in _WHOLE or isinstance(fields[i].dataType, T.DecimalType) and fields[i].dataType.precision <= 18 else "d" if fields[i].dataType.typeName() in ("float", "double") or "interval" in fields[i].dataType.typeName() else "h" for i in columns]
    picked = df.select(*[x["ldh".index(k)].alias(f"c{j}") for j, (x, k) in enumerate(zip(lanes, kinds))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: list[set] = [set() for _ in columns]
        for batch in batches:
            for j, s in enumerate(sets):
                if len(s) < most:
                    s.update(pc.unique(batch.column(j).drop_null()).slice(0, 2 * most).to_pylist())
        rows = [(i, k, v) for i, k, s in zip(columns, kinds, sets, strict=True) for v in list(s)[:most]]
        lane = lambda k: [v if kind == k else None for _, kind, v in rows]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in rows], pa.int32()), pa.array(lane("l"), pa.int64()), pa.array(lane("d"), pa.float64()), pa.array(lane("h"), pa.binary())], names=["i", "l", "d", "h"])

    return picked.mapInArrow(run, "i int, l long, d double, h binary").distinct()


def detect_targets(tables: dict[str, DataFrame], head_rows: int = 2000) -> list[tuple[str, str, str, int]]:
    """``(table, target, problem_type, unique_values)`` of many tables in three jobs.

    1. some rows of each table; 2. bounded value sets of the numbers that may still have at most 10 values; 3. the
    exact distinct count of the one column that is left for each table (or of every column, where the rows
    settled nothing), by typed short keys.
    """
    names, dfs = list(tables), list(tables.values())
    opened = [_left_open(df, values) for df, values in zip(dfs, _head(dfs, head_rows))]
    few, parts = {}, None
    for t, (df, o) in enumerate(zip(dfs, opened)):
        if o.few:
            part = bounded_sets(df, list(o.few)).select(F.lit(t).alias("t"), "*")
            parts = part if parts is None else parts.unionByName(part)
    if parts is not None:
        few = {(r["t"], r["i"]): r["n"] for r in parts.groupBy("t", "i").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen: dict[int, int] = {}
    counted, unique = None, {}
    for t, (df, o) in enumerate(zip(dfs, opened)):
        fields = df.schema.fields
        text = [column_class(f.dataType) == CATEGORICAL for f in fields]
        if o.everything:
            wanted = [f.name for f in fields]
        else:
            chosen[t] = o.named if o.named is not None else next((i for i in o.few if (n := few.get((t, i), 0)) and (text[i] or n <= FEW)), o.sure)
            if o.named is None and not text[chosen[t]]:
                unique[t] = few[t, chosen[t]]  # its set is whole
                continue
            wanted = [fields[chosen[t]].name]
        part = key_counts(df, wanted).where(present()).select(F.lit(t).alias("t"), F.col("col_idx").alias("i"))
        counted = part if counted is None else counted.unionByName(part)
    exact = {(r["t"], r["i"]): r["n"] for r in counted.groupBy("t", "i").agg(F.count(F.lit(1)).alias("n")).collect()} if counted is not None else {}
    out = []
    for t, (name, df, o) in enumerate(zip(names, dfs, opened)):
        fields = df.schema.fields
        if o.everything:
            stats = [ColumnStats(i, f.name, column_class(f.dataType) == CATEGORICAL, is_loose_numeric(f.dataType), int((t, i) in exact), exact.get((t, i), 0)) for i, f in enumerate(fields)]
            if not any(s.present for s in stats):
                continue
            chosen[t] = choose_target(stats).idx
        f = fields[chosen[t]]
        n = unique.get(t, exact.get((t, chosen[t]), 0))
        out.append((name, f.name, problem_type_rule(is_loose_numeric(f.dataType), n), n))
    return out


def detect_target_frame(df: DataFrame) -> DataFrame:
    """The target rule as a frame: ``(target, problem_type, unique_values)``; no row for a table without a value."""
    return df.sparkSession.createDataFrame([r[1:] for r in detect_targets({"": df})], "target string, problem_type string, unique_values long")


def target_by_substring(columns: list[str]) -> str | None:
    """Interactive preselect: every column containing a pattern is assigned in turn, so the last one wins."""
    chosen = None
    for c in columns:
        if any(p in c.lower() for p in TARGET_SUBSTRINGS):
            chosen = c
    return chosen


def problem_types(df: DataFrame) -> DataFrame:
    """E2 rule for every column: ``(column_idx, column_name, unique_values, loose_numeric, problem_type)``."""
    prof = column_profile(df)
    loose = [is_loose_numeric(f.dataType) for f in df.schema.fields]
    ln = F.element_at(F.array(*[F.lit(x) for x in loose]), F.col("column_idx") + 1)
    return prof.select(
        "column_idx", "column_name", F.col("distinct_count").alias("unique_values"), ln.alias("loose_numeric"),
        problem_type_col(ln, F.col("distinct_count")).alias("problem_type"),
    )


def analyze_target(df: DataFrame, column: str, order_by: list[str] | None = None, samples: int = 10) -> DataFrame:
    """Target analysis row; a one-row error record when the column is unknown."""
    spark = df.sparkSession
    schema = ("success boolean, error string, column_name string, unique_count long, missing_count long, "
              "total_rows long, data_type string, sample_values string, missing_pct double, detected_type string, "
              "type_confidence string")
    if column not in df.columns:
        return spark.createDataFrame([(False, f"Column '{column}' not found in dataset", column) + (None,) * 8], schema)
    f = df.schema[column]
    v = normalized(column, f.dataType)
    loose = is_loose_numeric(f.dataType)
    stats = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(missing_mask(column, f.dataType)).alias("missing_count"),
        F.count_distinct(v).alias("unique_count"),
        (F.coalesce(F.bool_and(whole_number(v)), F.lit(True)) if loose else F.lit(False)).alias("all_whole"),
    )
    order_by = order_by or [df.columns[0]]
    first = (
        df.select(*[qcol(k).alias(f"__k{i}") for i, k in enumerate(order_by)], v.alias("__v"))
        .where(F.col("__v").isNotNull())
        .orderBy(*[f"__k{i}" for i in range(len(order_by))], "__v")
        .limit(samples)
    )
    text = F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(*[F.col(f"__k{i}") for i in range(len(order_by))], F.col("__v")))),
        lambda s: s["__v"].cast("string")), ", ")
    sample = first.agg(text.alias("sample_values"))
    u = F.col("unique_count")
    detected = (F.when(F.lit(loose) & (u <= 10) & F.col("all_whole"), "classification")
                .when(F.lit(loose), "regression").otherwise("classification"))
    # two one-row aggregates side by side: union + max, no join
    names = ["total_rows", "missing_count", "unique_count", "all_whole"]
    empty = [F.lit(None).cast(stats.schema[c].dataType).alias(c) for c in names]
    one = stats.withColumn("sample_values", F.lit(None).cast("string")).unionByName(
        sample.select(*empty, "sample_values")).agg(*[F.max(c).alias(c) for c in [*names, "sample_values"]])
    return one.select(
        F.lit(True).alias("success"), F.lit(None).cast("string").alias("error"), F.lit(column).alias("column_name"),
        u.cast("long").alias("unique_count"), F.col("missing_count").cast("long").alias("missing_count"),
        F.col("total_rows").cast("long").alias("total_rows"), F.lit(f.dataType.simpleString()).alias("data_type"),
        F.coalesce(F.col("sample_values"), F.lit("")).alias("sample_values"),
        F.coalesce(pct2("missing_count", "total_rows"), F.lit(0.0)).alias("missing_pct"),
        detected.alias("detected_type"),
        F.when(u <= 10, "high").otherwise("medium").alias("type_confidence"),
    )


def quick_type(df: DataFrame, order_by: list[str] | None = None, n: int = 5) -> DataFrame:
    """Type guess per column from the first n rows (the preview), as text values.

    ≤10 distinct and no value parses as a non-integer number → classification;
    else all values parse as numbers → regression; else classification.
    """
    order_by = order_by or [df.columns[0]]
    types = {f.name: f.dataType for f in df.schema.fields}
    head = df.orderBy(*[qcol(k) for k in order_by]).limit(n)
    stacked = head.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("column_idx"), F.lit(c).alias("column_name"),
                 normalized(c, types[c]).cast("string").alias("v"))
        for i, c in enumerate(df.columns)
    ])).alias("s")).select("s.*").where(F.col("v").isNotNull() & (F.col("v") != ""))
    num = F.col("v").try_cast("double")
    agg = stacked.groupBy("column_idx", "column_name").agg(
        F.count_distinct("v").alias("unique_values"),
        F.count_if(num.isNotNull() & (num != F.floor(num))).alias("fractional"),
        F.count_if(num.isNull()).alias("unparsed"),
    )
    guess = (F.when((F.col("unique_values") <= 10) & (F.col("fractional") == 0), "classification")
             .when(F.col("unparsed") == 0, "regression").otherwise("classification"))
    return agg.select("column_idx", "column_name", F.col("unique_values").cast("long").alias("unique_values"),
                      guess.alias("quick_type"))


def _ratio_error(split_ratio) -> str | None:
    try:
        ratio = float(split_ratio)
    except (TypeError, ValueError):
        return "Split ratio must be a valid number"
    return None if 0 < ratio < 1 else "Split ratio must be between 0 and 1"


def validate_configs(df: DataFrame, configs: list[tuple[str, str, object]]) -> DataFrame:
    """Validate many ``(target, problem_type, split_ratio)`` settings against one profile job.

    Output ``(target, problem_type, split_ratio, valid, errors)``; all errors
    of a setting are collected, joined by ' | ', in a fixed order.
    """
    spark = df.sparkSession
    wanted = sorted({t for t, _, _ in configs if t in df.columns}, key=df.columns.index)
    prof = column_profile(df, key_counts(df, wanted)) if wanted else None
    grid = spark.createDataFrame(
        [(str(t), str(p), str(r), t in df.columns, p in PROBLEM_TYPES, _ratio_error(r)) for t, p, r in configs],
        "target string, problem_type string, split_ratio string, known boolean, type_ok boolean, ratio_error string")
    # the table's size beside the settings: union + max, no join
    rows = df.agg(F.count(F.lit(1)).alias("n_rows"))
    settings = F.collect_list(F.struct(*grid.columns)).alias("settings")
    one = grid.agg(settings).select("settings", F.lit(None).cast("long").alias("n_rows")).unionByName(rows.select(F.lit(None).cast(grid.agg(settings).schema[0].dataType).alias("settings"), "n_rows"))
    g = one.agg(F.first("settings", ignorenulls=True).alias("settings"), F.max("n_rows").alias("n_rows")).select(F.explode("settings").alias("s"), "n_rows").select("s.*", "n_rows")
    if prof is not None:
        stats = prof.select(F.col("column_name").alias("target"), (F.col("rows") - F.col("missing")).alias("present"),
                            F.col("distinct_count").alias("unique"))
        g = g.join(F.broadcast(stats), "target", "left")
    else:
        g = g.withColumn("present", F.lit(None).cast("long")).withColumn("unique", F.lit(None).cast("long"))
    errs = F.array_compact(F.array(
        F.when(~F.col("known"), F.concat(F.lit("Target column '"), F.col("target"), F.lit("' not found in dataset")))
         .when(F.col("present") == 0, F.concat(F.lit("Target column '"), F.col("target"),
                                               F.lit("' contains no valid values"))),
        F.when(~F.col("type_ok"), F.concat(F.lit("Invalid problem type '"), F.col("problem_type"),
                                           F.lit(f"'. Must be one of {list(PROBLEM_TYPES)}"))),
        F.col("ratio_error"),
        F.when(F.col("n_rows") < MIN_TRAIN_ROWS, F.lit("Dataset too small. Need at least 10 rows for training")),
        F.when(F.col("known") & F.col("problem_type").isin("classification", "binary", "multiclass")
               & (F.col("unique") < 2),
               F.concat(F.lit("Classification requires at least 2 unique target values, found "),
                        F.col("unique").cast("string"))),
    ))
    return g.select("target", "problem_type", "split_ratio", (F.size(errs) == 0).alias("valid"),
                    F.array_join(errs, " | ").alias("errors"))


def validate_config(df: DataFrame, target: str, problem_type: str, split_ratio) -> DataFrame:
    return validate_configs(df, [(target, problem_type, split_ratio)]).select("valid", "errors")


def check_config(df: DataFrame, target: str, problem_type: str, split_ratio) -> None:
    """Raise with every error when the configuration is invalid (fail fast before training)."""
    r = validate_config(df, target, problem_type, split_ratio).first()
    if not r["valid"]:
        raise ValueError(r["errors"])


def upload_type_labels(df: DataFrame) -> DataFrame:
    """Two-way labels shown after loading: 'numeric' by the loose test (booleans included), else 'categorical'."""
    rows = [(i, f.name, "numeric" if is_loose_numeric(f.dataType) else "categorical")
            for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "column_idx int, column_name string, label string")
