"""Legends, codes and constants that results must agree on, and helpers that turn sentinels into NULL at the scan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scaled-index encoding and its sentinels.
INDEX_SCALE = 10000.0
INDEX_NODATA = -32768
INDEX_LIMIT = 32767
MASK_NODATA = 255
SCORE_SCALE = 10000
SCORE_NODATA = 65535

# Scene classes that are never an observation, and the class that is water.
SCL_REJECT = (0, 1, 3, 8, 9, 10, 11)
SCL_WATER = 6
WATER_RELAX = 0.15

# Surface classes.
SURFACE = {
    "INVALID": 0, "OPEN_WATER": 1, "SHALLOW_OR_MIXED_WATER": 2, "WET_SEDIMENT": 3, "DRY_BARE_SEDIMENT": 4,
    "SPARSE_HERBACEOUS": 5, "DENSE_HERBACEOUS": 6, "REED_OR_FLOODED_VEGETATION": 7, "BUILT_HARD_SURFACE": 8, "AMBIGUOUS": 9,
}


def number_or_null(x: Column, sentinel=None) -> Column:
    """NaN and the sentinel become NULL: both engines would rank NaN above every number."""
    x = F.when(F.isnan(x.cast("double")), None).otherwise(x)
    return x if sentinel is None else F.when(x != sentinel, x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return a / F.when(b != 0, b)


def fails_if_null(x: Column, instead) -> Column:
    """x, or a value that is sure to fail the test that follows."""
    return F.coalesce(x, F.lit(instead))
