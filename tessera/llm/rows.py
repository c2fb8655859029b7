"""Carrying a frame's other columns through an operator, whatever their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def named(column: str) -> Column:
    """The column of exactly this name (dots and back ticks are part of it)."""
    return F.col("`" + column.replace("`", "``") + "`")


def packed(df: DataFrame, without: tuple[str, ...] = ()) -> Column:
    """All columns but ``without`` as one struct, so that no name of theirs meets one of the operator's."""
    kept = [named(c) for c in df.columns if c not in without]
    return F.struct(*kept) if kept else F.struct(F.lit(None).cast("boolean").alias("none"))


def unpacked(df: DataFrame, source: DataFrame, without: tuple[str, ...] = (), row: str = "row") -> list[Column]:
    """The columns that :func:`packed` put into ``row`` of ``df``."""
    return [F.col(row).getField(c).alias(c) for c in source.columns if c not in without]
