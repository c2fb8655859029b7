"""Feature engineering: imputing, scaling, capped one-hot, ordinal codes, target codes.

``fit_features(df, target)`` learns a :class:`FeatureModel` with a handful
of distributed jobs and returns it; ``FeatureModel.transform`` is a pure
DataFrame plan (projections + at most one equi-join per high-cardinality
column) ending in a ``VectorAssembler``.

Rules (the reference's preprocessing, re-expressed):

* numeric columns — mean impute, then standard-scale with the population σ
  of the imputed column (σ = 0 → 1);
* text columns with ≤ 50 distinct values — most-frequent impute (tie →
  smallest), one-hot with at most 10 outputs: when there are more than 10
  categories the 9 most frequent are kept (count tie → larger value kept)
  and the rest share an "infrequent" column; the first kept category in
  sorted order is dropped; unseen categories encode as all zeros;
* text columns with > 50 distinct values — sorted integer codes of the text
  (missing is the class ``"nan"``), then treated as numeric (scaled);
* other types (boolean, dates, timestamps, nested) and all-missing columns
  are dropped;
* a text target gets sorted integer codes (missing → ``"nan"``); rows with
  a missing numeric target are dropped (and counted).

Everything that reaches the driver is bounded: per-column moments, ≤ 50
category counts per low-cardinality column, and vocabulary sizes.  The
high-cardinality vocabularies stay distributed tables.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.types import qcol, CATEGORICAL, NUMERIC, column_class, missing_mask, normalized
from tessera.operators.keys import key_counts, present, with_values
from tessera.session import materialise

# fixed values: the encoder's thresholds (defaults of fit_features)
HIGH_CARDINALITY = 50
MAX_CATEGORIES = 10
NAN_CLASS = "nan"
# codes are joined on a 32-byte digest, so this many rows are some 10 MB whatever the text
BROADCAST_CODES = 200_000
#: Characters of a value that ranges of a sort are drawn by, rows from which more of them are taken, and for how many starts.
RANGE_CHARS, RANGE_ROWS, RANGE_STARTS = 48, 500, 1_000
_EPS = 10 * 2.220446049250313e-16


def _q(n: str) -> str:
    return "`" + n.replace("`", "``") + "`"


@dataclass
class NumericSpec:
    name: str
    mean: float
    scale: float
    ordinal: bool = False  # values come from the ordinal code of a text column
    kind: str = ""  # Spark type in the fit


@dataclass
class OneHotSpec:
    name: str
    mode: str
    kept: list[str]
    infrequent: list[str]

    def outputs(self) -> list[tuple[str, list[str]]]:
        """``[(feature suffix, values that set it)]`` after dropping the first kept category."""
        outs = [(v, [v]) for v in self.kept[1:]]
        if self.infrequent:
            outs.append(("infrequent_sklearn", list(self.infrequent)))
        return outs


@dataclass
class FeatureSpec:
    target: str
    target_kind: str  # "numeric" | "text"
    numeric: list[NumericSpec] = field(default_factory=list)
    onehot: list[OneHotSpec] = field(default_factory=list)
    ordinal: list[str] = field(default_factory=list)
    original_columns: list[str] = field(default_factory=list)
    target_classes: int | None = None
    dropped_target_rows: int = 0

    def feature_names(self) -> list[str]:
        names = [f"num__{n.name}" for n in self.numeric]
        for o in self.onehot:
            names += [f"cat__{o.name}_{suffix}" for suffix, _ in o.outputs()]
        return names

    def used_columns(self) -> list[str]:
        return [n.name for n in self.numeric] + [o.name for o in self.onehot]

    def to_json(self) -> str:
        return json.dumps({
            "target": self.target, "target_kind": self.target_kind,
            "numeric": [n.__dict__ for n in self.numeric], "onehot": [o.__dict__ for o in self.onehot],
            "ordinal": self.ordinal, "original_columns": self.original_columns,
            "target_classes": self.target_classes, "dropped_target_rows": self.dropped_target_rows,
        })

    @staticmethod
    def from_json(text: str) -> "FeatureSpec":
        d = json.loads(text)
        return FeatureSpec(
            d["target"], d["target_kind"], [NumericSpec(**n) for n in d["numeric"]],
            [OneHotSpec(**o) for o in d["onehot"]], d["ordinal"], d["original_columns"], d["target_classes"],
            d.get("dropped_target_rows", 0))


# ----------------------------------------------------------------------------- vocabularies
def range_key(cells: DataFrame) -> Column:
    """The start of ``value`` by which ranges of ``(col_idx, value)`` are drawn: ``RANGE_CHARS``
    characters, more for the commonest starts, where over ``RANGE_ROWS`` rows of longer texts begin alike.

    Spark takes a sample of the keys to the driver, so whole texts are no keys.  A smaller
    value never has a larger start, whichever starts share a hash.
    """
    chars, key, left = RANGE_CHARS, F.substring("value", 1, RANGE_CHARS), cells
    while True:
        start = F.xxhash64("col_idx", F.substring("value", 1, chars))
        left = left.where(F.char_length("value") > chars)
        most = left.groupBy(start.alias("start")).count().orderBy(F.desc("count")).limit(RANGE_STARTS).collect()
        alike = [r["start"] for r in most if r["count"] > RANGE_ROWS]
        if not alike:
            return key
        key = F.when(start.isin(alike), F.substring("value", 1, 8 * chars)).otherwise(key)
        left, chars = left.where(start.isin(alike)), 8 * chars


def vocabularies(df: DataFrame, columns: list[str]) -> dict[str, tuple[DataFrame, int, float, float]]:
    """column -> sorted vocabulary ``(value, code)``, its size, and mean and variance of the codes over the rows.

    One job for all columns, however many: counts of ``(column, value)`` (partial
    aggregation absorbs hot values), one sort by both, range-partitioned by the values'
    first characters, one contiguous index.  A code is the index less the column's first one; the moments
    come from the counts, not from another pass over the rows.  The table lies in the
    shared folder; nothing is kept in memory and no task holds a vocabulary.
    """
    from tessera.operators.sampling import dense_index

    if not columns:
        return {}
    names = df.columns
    cells = F.explode(F.array(*[F.struct(F.lit(names.index(c)).alias("col_idx"), F.coalesce(qcol(c).cast("string"), F.lit(NAN_CLASS)).alias("value"))
                                for c in columns])).alias("cell")
    values = df.select(cells).select("cell.col_idx", "cell.value")
    counted = values.groupBy("col_idx", "value").agg(F.count(F.lit(1)).alias("cnt"))
    ordered = counted.repartitionByRange("col_idx", range_key(values)).sortWithinPartitions("col_idx", "value")
    table = materialise(dense_index(ordered, "place"), "vocabularies")
    first = {r["col_idx"]: r for r in table.groupBy("col_idx").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("size")).collect()}  # one row a column
    start = F.element_at(F.map_from_arrays(F.array(*[F.lit(i) for i in first]), F.array(*[F.lit(r["first"]) for r in first.values()])), F.col("col_idx"))
    coded = table.withColumn("code", F.col("place") - start) if first else table.withColumn("code", F.col("place"))
    mean = F.sum(F.col("cnt") * F.col("code").cast("double")) / F.sum("cnt")
    means = {r["col_idx"]: r["m"] for r in coded.groupBy("col_idx").agg(mean.alias("m")).collect()}
    spread = {}
    if means:
        off = F.col("code") - F.element_at(F.map_from_arrays(F.array(*[F.lit(i) for i in means]), F.array(*[F.lit(m) for m in means.values()])), F.col("col_idx"))
        spread = {r["col_idx"]: r["v"] for r in coded.groupBy("col_idx").agg((F.sum(F.col("cnt") * off * off) / F.sum("cnt")).alias("v")).collect()}
    out = {}
    for c in columns:
        i = names.index(c)
        own = coded.where(F.col("col_idx") == i).select("value", "code")
        out[c] = (own, int(first[i]["size"]) if i in first else 0, float(means.get(i) or 0.0), float(spread.get(i) or 0.0))
    return out


def text_codes(df: DataFrame, column: str) -> DataFrame:
    """Sorted vocabulary ``(value, code)`` of ``coalesce(column, 'nan')`` — distributed."""
    return vocabulary(df, column)[0]


def vocabulary(df: DataFrame, column: str) -> tuple[DataFrame, int]:
    """Sorted vocabulary and its counted size (the size decides broadcast vs shuffle joins)."""
    return vocabularies(df, [column])[column][:2]


def _digest(text) -> Column:
    return F.unhex(F.sha2(text, 256))


def apply_codes(df: DataFrame, column: str, vocab: DataFrame, out: str, size: int | None = None) -> DataFrame:
    """Replace a text column by its code (unknown values → null).

    The join key is the value's SHA-256, so no text is moved, and broadcasting
    depends on the number of codes alone.  Missing cells take the code of
    ``"nan"`` without a join; their keys are spread so that they match nothing
    and meet nowhere.
    """
    value = qcol(column).cast("string")
    missing = vocab.where(F.col("value") == NAN_CLASS).select("code").first()
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(4096)).cast("string").cast("binary")
    left = df.withColumn("__key", F.coalesce(_digest(value), spread))
    v = vocab.select(_digest(F.col("value")).alias("__key"), F.col("code").alias("__found"))
    if size is not None and size <= BROADCAST_CODES:
        v = F.broadcast(v)
    code = F.when(value.isNull(), F.lit(missing["code"] if missing else None).cast("long")).otherwise(F.col("__found"))
    return left.join(v, "__key", "left").withColumn(out, code).drop("__key", "__found")


def check_columns(spec: FeatureSpec, df: DataFrame) -> None:
    """Refuse a frame that lacks a feature column or has it with another kind of type."""
    types = {f.name: f.dataType for f in df.schema.fields}
    wanted = {n.name: CATEGORICAL if n.ordinal else NUMERIC for n in spec.numeric}
    wanted |= {o.name: CATEGORICAL for o in spec.onehot}
    missing = [c for c in wanted if c not in types]
    if missing:
        raise ValueError(f"Missing feature columns: {', '.join(missing)}")
    other = [c for c, kind in wanted.items() if column_class(types[c]) != kind]
    if other:
        raise ValueError(f"Feature columns with another type than in the fit: {', '.join(other)}")


# ----------------------------------------------------------------------------- fitting
@dataclass
class FeatureModel:
    spec: FeatureSpec
    vocabs: dict[str, DataFrame]
    vocab_sizes: dict[str, int]
    target_vocab: DataFrame | None = None

    # -- transform -----------------------------------------------------------
    def check_columns(self, df: DataFrame) -> None:
        check_columns(self.spec, df)

    def encode(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """Feature columns (named as ``feature_names()``) plus ``label`` (when the target exists) and ``keep``."""
        keep = list(keep or [])
        self.check_columns(df)
        cur = df
        for c in self.spec.ordinal:
            cur = apply_codes(cur, c, self.vocabs[c], f"__code_{c}", self.vocab_sizes.get(c))
        has_target = self.spec.target in df.columns
        if has_target and self.spec.target_kind == "text":
            cur = apply_codes(cur, self.spec.target, self.target_vocab, "__label", self.spec.target_classes)
        elif has_target:
            f = df.schema[self.spec.target]
            cur = cur.withColumn("__label", normalized(self.spec.target, f.dataType).cast("double"))
        types = {f.name: f.dataType for f in df.schema.fields}
        cols = [qcol(k) for k in keep]
        names = self.spec.feature_names()
        i = 0
        for n in self.spec.numeric:
            src = F.col(f"`__code_{n.name}`").cast("double") if n.ordinal else normalized(n.name, types[n.name]).cast(
                "double")
            cols.append(((F.coalesce(src, F.lit(n.mean)) - F.lit(n.mean)) / F.lit(n.scale)).alias(names[i]))
            i += 1
        for o in self.spec.onehot:
            imp = F.coalesce(qcol(o.name).cast("string"), F.lit(o.mode))
            for _suffix, vals in o.outputs():
                hit = imp.isin(*vals) if len(vals) > 1 else (imp == F.lit(vals[0]))
                cols.append(hit.cast("double").alias(names[i]))
                i += 1
        if has_target:
            cols.append(F.col("__label").cast("double").alias("label"))
        return cur.select(cols)

    def transform(self, df: DataFrame, keep: list[str] | None = None, output_col: str = "features") -> DataFrame:
        """Assembled ``features`` vector (+ ``label`` and ``keep`` columns)."""
        enc = self.encode(df, keep)
        at = {c: f"__f{i}" for i, c in enumerate(self.spec.feature_names())}  # the assembler takes no name with a dot or a back tick
        enc = enc.toDF(*[at.get(c, c) for c in enc.columns])
        names = list(at.values())
        va = VectorAssembler(inputCols=names, outputCol=output_col, handleInvalid="error")
        out = va.transform(enc)
        return out.select(*[c for c in out.columns if c not in names])

    def feature_names(self) -> list[str]:
        return self.spec.feature_names()

    # -- persistence -----------------------------------------------------------
    def save(self, path: str) -> None:
        spark = next(iter(self.vocabs.values())).sparkSession if self.vocabs else (
            self.target_vocab.sparkSession if self.target_vocab is not None else SparkSession.getActiveSession())
        spark.createDataFrame([(self.spec.to_json(),)], "spec string").coalesce(1).write.mode("overwrite").json(
            f"{path}/spec")
        for c, v in self.vocabs.items():
            v.write.mode("overwrite").parquet(f"{path}/vocab/{_safe(c)}")
        if self.target_vocab is not None:
            self.target_vocab.write.mode("overwrite").parquet(f"{path}/target_vocab")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "FeatureModel":
        spec = FeatureSpec.from_json(spark.read.json(f"{path}/spec").first()["spec"])
        vocabs = {c: spark.read.parquet(f"{path}/vocab/{_safe(c)}") for c in spec.ordinal}
        sizes = {c: v.count() for c, v in vocabs.items()}
        tv = spark.read.parquet(f"{path}/target_vocab") if spec.target_kind == "text" else None
        return FeatureModel(spec, vocabs, sizes, tv)


def _safe(name: str) -> str:
    return "".join(ch if ch.isalnum() or ch in "_-" else f"%{ord(ch):02x}" for ch in name)


def onehot_spec(name: str, counts: list[tuple[str, int]], missing: int,
                max_categories: int = MAX_CATEGORIES) -> OneHotSpec:
    """Capped one-hot layout from (value, count) pairs of a low-cardinality column."""
    if not counts:
        return OneHotSpec(name, NAN_CLASS, [], [])
    mode = sorted(counts, key=lambda vc: (-vc[1], vc[0]))[0][0]
    imputed = {v: c + (missing if v == mode else 0) for v, c in counts}
    cats = sorted(imputed)
    if len(cats) > max_categories:
        frequent = sorted(cats, key=lambda v: (-imputed[v], _desc_key(v)))[: max_categories - 1]
        kept = sorted(frequent)
        infrequent = [v for v in cats if v not in set(frequent)]
    else:
        kept, infrequent = cats, []
    return OneHotSpec(name, mode, kept, infrequent)


class _desc_key:
    """Sort key that orders strings descending (count tie → larger value first)."""

    __slots__ = ("v",)

    def __init__(self, v: str):
        self.v = v

    def __lt__(self, other: "_desc_key") -> bool:
        return self.v > other.v


def fit_features(df: DataFrame, target: str, fit_rows: DataFrame | None = None, high_cardinality: int = HIGH_CARDINALITY,
                 max_categories: int = MAX_CATEGORIES) -> FeatureModel:
    """Learn the preprocessing of ``df`` for ``target``.

    ``fit_rows`` (default: ``df``) are the rows whose statistics are used —
    pass the training split for ``fit_scope='train'``.
    """
    if target not in df.columns:
        raise ValueError(f"Target column '{target}' not found in dataset")
    src = df if fit_rows is None else fit_rows
    tfield = df.schema[target]
    target_kind = "text" if column_class(tfield.dataType) == CATEGORICAL else "numeric"
    if target_kind == "numeric" and not isinstance(tfield.dataType, (T.NumericType, T.BooleanType)):
        raise ValueError(f"Target column '{target}' has type {tfield.dataType.simpleString()}; use a numeric or text column")
    dropped = 0
    if target_kind == "numeric":
        keep = ~missing_mask(target, tfield.dataType)
        src = src.where(keep)
    xs = [f for f in df.schema.fields if f.name != target]
    num = [f for f in xs if column_class(f.dataType) == NUMERIC]
    cat = [f for f in xs if column_class(f.dataType) == CATEGORICAL]

    # job 1: moments of numeric columns + row count (one agg)
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, f in enumerate(num):
        v = normalized(f.name, f.dataType).cast("double")
        aggs += [F.count(v).alias(f"c{i}"), F.avg(v).alias(f"m{i}"), F.var_pop(v).alias(f"v{i}")]
    mom = src.agg(*aggs).first()
    n_rows = int(mom["__n"])

    # job 2: category counts of text columns (frequency table; ≤ 51 rows per column collected)
    cat_counts: dict[str, list[tuple[str, int]]] = {f.name: [] for f in cat}
    cat_missing: dict[str, int] = {f.name: 0 for f in cat}
    distinct: dict[str, int] = {f.name: 0 for f in cat}
    if cat:
        names = [f.name for f in src.schema.fields]
        # one pass of short keys; only the values of the small columns fetch their text
        counts = materialise(key_counts(src, [f.name for f in cat], head=True), "category-counts")
        here = present()
        per = counts.groupBy("col_idx").agg(F.count_if(here).alias("d"), F.sum(F.when(~here, F.col("cnt"))).alias("m"))
        for r in per.collect():  # ≤ one row per text column
            nm = names[r["col_idx"]]
            distinct[nm] = int(r["d"])
            cat_missing[nm] = int(r["m"] or 0)
        small = [names.index(c) for c in distinct if 0 < distinct[c] <= high_cardinality]
        if small:
            rows = with_values(src, counts.where(here & F.col("col_idx").isin(small))).collect()  # ≤ 50 per column
            for r in rows:
                cat_counts[names[r["col_idx"]]].append((r["value"], int(r["cnt"])))

    numeric_specs: list[NumericSpec] = []
    filled = {f.name: int(mom[f"c{i}"]) for i, f in enumerate(num)}
    # numeric columns and ordinal-coded text columns, in original column order
    vocabs: dict[str, DataFrame] = {}
    sizes: dict[str, int] = {}
    onehots: list[OneHotSpec] = []
    ordinal: list[str] = []
    num_idx = {f.name: i for i, f in enumerate(num)}
    many = [c for c in distinct if distinct[c] > high_cardinality]
    # the target's codes are of all rows: a class that only the test side has is an error, not a gap
    text_target = [target] if target_kind == "text" else []
    together = fit_rows is None
    coded = vocabularies(src, many + text_target if together else many)
    for f in xs:
        if f.name in num_idx:
            i = num_idx[f.name]
            if filled[f.name] == 0:
                continue  # all-missing column dropped
            mean = float(mom[f"m{i}"])
            var = float(mom[f"v{i}"] or 0.0) * filled[f.name] / max(n_rows, 1)
            sd = var ** 0.5
            numeric_specs.append(NumericSpec(f.name, mean, sd if sd >= _EPS else 1.0, kind=f.dataType.simpleString()))
        elif f.name in distinct:
            if distinct[f.name] == 0:
                continue
            if distinct[f.name] > high_cardinality:
                vocabs[f.name], sizes[f.name], mean, var = coded[f.name]
                ordinal.append(f.name)
                sd = var ** 0.5
                numeric_specs.append(NumericSpec(f.name, mean, sd if sd >= _EPS else 1.0, ordinal=True, kind=f.dataType.simpleString()))
            else:
                onehots.append(onehot_spec(f.name, cat_counts[f.name], cat_missing[f.name], max_categories))
    if not numeric_specs and not onehots:
        raise ValueError("No valid columns found for preprocessing")

    target_vocab = None
    classes = None
    if target_kind == "text":
        target_vocab, classes = coded[target][:2] if together else vocabulary(df, target)
    else:
        dropped = df.where(missing_mask(target, tfield.dataType)).count()
    spec = FeatureSpec(target, target_kind, numeric_specs, onehots, ordinal, [f.name for f in xs], classes, dropped)
    return FeatureModel(spec, vocabs, sizes, target_vocab)


# ----------------------------------------------------------------------------- simple fallback (F9)
def simple_features(df: DataFrame) -> DataFrame:
    """Fallback encoding: sorted codes for text columns, mean fill for numbers, 0 for anything left."""
    cur = df
    for c, (vocab, size, _, _) in vocabularies(df, [f.name for f in df.schema.fields if column_class(f.dataType) == CATEGORICAL]).items():
        cur = apply_codes(cur, c, vocab, f"__code_{c}", size)
    types = {f.name: f.dataType for f in df.schema.fields}
    means = df.agg(*[F.avg(normalized(f.name, f.dataType).cast("double")).alias(f.name)
                     for f in df.schema.fields if column_class(f.dataType) == NUMERIC] or [F.lit(0)]).first()
    cols = []
    for f in df.schema.fields:
        cls = column_class(f.dataType)
        if cls == CATEGORICAL:
            cols.append(F.col(f"`__code_{f.name}`").cast("long").alias(f.name))
        elif cls == NUMERIC:
            m = means[f.name]
            v = normalized(f.name, types[f.name]).cast("double")
            cols.append(F.coalesce(v, F.lit(float(m) if m is not None else 0.0), F.lit(0.0)).alias(f.name))
        else:
            cols.append(qcol(f.name))
    return cur.select(cols).fillna(0)


def target_codes(df: DataFrame, target: str) -> DataFrame:
    """Target encoding alone: ``(…, label)`` with sorted codes for text targets."""
    vocab, size = vocabulary(df, target)
    return apply_codes(df, target, vocab, "label", size)


# ----------------------------------------------------------------------------- single-step operators
def impute_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing numeric cells → column mean (one ``agg``)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    means = df.agg(*[F.avg(normalized(c, types[c]).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    repl = {c: F.coalesce(normalized(c, types[c]).cast("double"), F.lit(means[f"m{i}"]).cast("double")).alias(c)
            for i, c in enumerate(columns)}
    return df.select([repl.get(c, qcol(c)) for c in df.columns])


def standard_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean-impute then scale by the population σ of the imputed column (σ = 0 → 1)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(columns):
        v = normalized(c, types[c]).cast("double")
        aggs += [F.count(v).alias(f"c{i}"), F.avg(v).alias(f"m{i}"), F.var_pop(v).alias(f"v{i}")]
    st = df.agg(*aggs).first()
    repl = {}
    for i, c in enumerate(columns):
        mean = st[f"m{i}"]
        if mean is None:
            continue
        sd = (float(st[f"v{i}"] or 0.0) * st[f"c{i}"] / max(st["n"], 1)) ** 0.5
        sd = sd if sd >= _EPS else 1.0
        v = F.coalesce(normalized(c, types[c]).cast("double"), F.lit(float(mean)))
        repl[c] = ((v - F.lit(float(mean))) / F.lit(sd)).alias(c)
    return df.select([repl.get(c, qcol(c)) for c in df.columns])


def impute_mode(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing cells → most frequent value (tie → smallest), from the frequency table."""
    from tessera.operators.profile import top_values

    tops = {r["column_name"]: r["value"] for r in top_values(df, 1, columns).collect()}  # ≤ one row per column
    types = {f.name: f.dataType for f in df.schema.fields}
    repl = {}
    for c in columns:
        if tops.get(c) is None:
            continue
        repl[c] = F.coalesce(normalized(c, types[c]), F.lit(tops[c]).cast(types[c])).alias(c)
    return df.select([repl.get(c, qcol(c)) for c in df.columns])


def to_long(encoded: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """``(keys…, feature, value)`` rows from wide feature columns."""
    return encoded.select(*[qcol(k) for k in keys], F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), qcol(f).cast("double").alias("value")) for f in features
    ])).alias("kv")).select(*keys, "kv.feature", "kv.value")
