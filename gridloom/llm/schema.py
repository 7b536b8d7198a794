"""Columns that the operators add to their inputs never clash: helpers for names and null-safe keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def held_out(name: str = "doc_id", folds: int = 5) -> Column:
    """The fold that no model learns from: crc32 of the id as text, modulo folds, is 0."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % folds == 0, F.lit(False))


def fresh(df: DataFrame, name: str) -> str:
    """name, with as many underscores at its end as it takes to be no column of df (letter case apart)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
