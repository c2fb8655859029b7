"""Sources: Parquet, CSV (pandas-compatible missing tokens and type inference), guards."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tessera.functions.types import qcol

# fixed values: the default missing-value tokens of the pandas CSV reader
PANDAS_NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)

# accepted upload extensions (the old binary .xls is not read)
UPLOAD_EXTENSIONS = ("csv", "xlsx")
TABLE_EXTENSIONS = UPLOAD_EXTENSIONS + ("parquet",)

_BOOL_TOKENS = ("true", "false")
# what reads as a number: no type letters, no hexadecimal floats
_INTEGER = r"^\s*[+-]?[0-9]+\s*$"
_REAL = r"(?i)^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity)\s*$"


def _number(c, kind: str):
    return F.when(c.rlike(_INTEGER if kind == "bigint" else _REAL), F.trim(c).try_cast(kind))


def file_extension(path: str) -> str:
    name = os.path.basename(path.rstrip("/"))
    return name.rsplit(".", 1)[1].lower() if "." in name else ""


def allowed_file(name: str, extensions=UPLOAD_EXTENSIONS) -> bool:
    """Extension check, case-insensitive (``X.CSV`` is a CSV)."""
    return bool(name) and file_extension(name) in extensions


# fixed values: the upload messages
def validate_upload(name: str | None, size_bytes: int | None = None) -> tuple[bool, str]:
    if not name:
        return False, "No file selected"
    if not allowed_file(name):
        return False, "Invalid file type. Only CSV and XLSX files are supported."
    if size_bytes is not None and size_bytes == 0:
        return False, "File is empty."
    return True, "File validation passed"


def ensure_rows(df: DataFrame) -> DataFrame:
    """Raise when the table has no rows (one tiny ``limit(1)`` job)."""
    if df.isEmpty():
        raise ValueError("File contains no data.")
    return df


def normalize_missing(df: DataFrame, tokens=PANDAS_NA_TOKENS) -> DataFrame:
    """Missing tokens in string columns → null; NaN in float columns → null."""
    cols = []
    toks = [F.lit(t) for t in tokens]
    for f in df.schema.fields:
        c = qcol(f.name)
        if isinstance(f.dataType, T.StringType):
            c = F.when(~c.isin(*toks), c)
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.when(~F.isnan(c), c)
        cols.append(c.alias(f.name))
    return df.select(cols)


def infer_types(df: DataFrame) -> DataFrame:
    """Cast all-string columns to long / double / boolean when every present value parses.

    One aggregation pass counts the parse successes per column (pandas-like:
    integers become 64-bit, reals double, ``True``/``False`` boolean, dates
    stay text).  The result row has 4 numbers per column — bounded.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not names:
        return df
    aggs = []
    for i, n in enumerate(names):
        c = qcol(n)
        aggs += [
            F.count(c).alias(f"n{i}"),
            F.count(_number(c, "bigint")).alias(f"l{i}"),
            F.count(_number(c, "double")).alias(f"d{i}"),
            F.count(F.when(F.lower(F.trim(c)).isin(*_BOOL_TOKENS), 1)).alias(f"b{i}"),
        ]
    r = df.agg(*aggs).first()
    target: dict[str, str] = {}
    for i, n in enumerate(names):
        present = r[f"n{i}"]
        if present == 0:
            target[n] = "double"  # all-missing column reads as float in pandas
        elif r[f"l{i}"] == present:
            target[n] = "bigint"
        elif r[f"d{i}"] == present:
            target[n] = "double"
        elif r[f"b{i}"] == present:
            target[n] = "boolean"
    cols = []
    for f in df.schema.fields:
        t = target.get(f.name)
        c = qcol(f.name)
        if t == "boolean":
            c = F.lower(F.trim(c)) == F.lit("true")
        elif t:
            c = _number(c, t)
        cols.append(c.alias(f.name))
    return df.select(cols)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, na_tokens=PANDAS_NA_TOKENS,
             multi_line: bool | None = None) -> DataFrame:
    """CSV with header; missing tokens normalised, types inferred as the pandas reader would.

    ``multi_line=None`` looks whether a line has an odd number of quotes; only then
    are files read unsplit, as quoted line breaks need.  Rows shorter than the header
    end in missing cells; a row with more cells raises, as in pandas.
    """
    if multi_line is None:
        quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
        multi_line = bool(spark.read.text(path).where(quotes % 2 == 1).limit(1).count())
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    if schema is not None:
        return normalize_missing(reader.schema(schema).csv(path), na_tokens)
    names = reader.option("inferSchema", False).csv(path).columns
    text = T.StructType([T.StructField(n, T.StringType()) for n in names])
    odd = "__bad_row"
    checked = reader.option("columnNameOfCorruptRecord", odd).option("enforceSchema", True).schema(
        T.StructType([*text.fields, T.StructField(odd, T.StringType())])).csv(path)
    wide = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names) + 1)])
    cells = F.from_csv(F.col(odd), wide.simpleString()[7:-1].replace(":", " "), {"escape": '"'})
    extra = checked.withColumn("__more", cells[f"c{len(names)}"]).where("__more IS NOT NULL").limit(1).collect()
    if extra:
        raise ValueError(f"A row has more than the {len(names)} cells of the header: {extra[0][odd][:200]}")
    return infer_types(normalize_missing(checked.drop(odd), na_tokens))


def read_table(spark: SparkSession, path: str, fmt: str | None = None,
               schema: T.StructType | None = None) -> DataFrame:
    """Dispatch on format or lower-cased extension: parquet, csv, xlsx."""
    fmt = (fmt or file_extension(path) or "parquet").lower()
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt == "csv":
        return read_csv(spark, path, schema=schema)
    if fmt in ("xlsx", "excel"):
        from tessera.sources.excel import read_xlsx

        return read_xlsx(spark, path)
    raise ValueError(f"Unsupported table format: {fmt}")


def read_fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
