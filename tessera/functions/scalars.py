"""Scalar column expressions (all JVM-side, codegen-friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tessera.functions.types import qcol


def _c(x) -> Column:
    return qcol(x) if isinstance(x, str) else x


def pct2(num, den) -> Column:
    """``round(num / den * 100, 2)`` with exact half-even rounding on integers.

    Works in integer arithmetic (hundredths of a percent), so every engine
    that evaluates the same rule gets the same double; ``null`` when den is 0.
    """
    n = _c(num).cast("decimal(20,0)") * F.lit(10000).cast("decimal(5,0)")
    d0 = _c(den).cast("decimal(20,0)")
    d = F.when(d0 > 0, d0)
    r = F.pmod(n, d)
    q = ((n - r) / d).cast("long")  # a whole number
    up = F.when(r * 2 > d, 1).when((r * 2 == d) & (q % 2 == 1), 1).otherwise(0)
    return (q + up).cast("double") / F.lit(100.0)


def whole_number(x) -> Column:
    """True when a non-null numeric value has no fractional part."""
    c = _c(x).cast("double")
    return c == F.floor(c)


def escape_html(x) -> Column:
    """HTML-escape a cell; null and any-case 'nan' become ''.

    Same characters as Python's ``html.escape(quote=True)``: ``&`` first,
    then ``<``, ``>``, ``"`` and ``'``.
    """
    s = _c(x).cast("string")
    out = s
    # fixed values: escape table of html.escape(quote=True)
    for raw, ent in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(ent))
    return F.when(s.isNull() | (F.lower(s) == F.lit("nan")), F.lit("")).otherwise(out)


def split_percentages(ratio) -> tuple[Column, Column]:
    """Train/test percentages: ``int(ratio*100)`` (truncation) and the rest to 100."""
    train = (_c(ratio).cast("double") * F.lit(100.0)).cast("int")
    return train, F.lit(100) - train


def hash_bucket(keys: list, seed: int = 42, buckets: int = 10000) -> Column:
    """Stable bucket in ``[0, buckets)`` from the md5 of ``key1:key2:...:seed``.

    md5 keeps the bucket identical across engines (the oracle uses the same
    rule), and does not depend on partitioning, so splits are reproducible.
    """
    text = F.concat_ws(":", *[_c(k).cast("string") for k in keys], F.lit(str(seed)))
    head = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    return F.pmod(head, F.lit(buckets))


def json_safe(value: Column, kind: T.DataType) -> Column:
    """NaN and infinities → null, binary → UTF-8 text, at any depth of arrays, structs and maps."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(F.abs(value) < F.lit(float("inf")), value)
    if isinstance(kind, T.BinaryType):
        return F.decode(value, "UTF-8")
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: json_safe(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: json_safe(x, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[json_safe(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]))
    return value


def json_safe_row(fields) -> Column:
    """``to_json`` of the row with JSON-safe values only."""
    parts = [json_safe(qcol(f.name), f.dataType).alias(f.name) for f in fields]
    # keys with missing values stay present as null (a dict dumped to JSON keeps them)
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})
