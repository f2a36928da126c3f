"""Per-key picks that stay safe when one key holds a large share of the rows.

``max`` / ``min`` of whole rows, and ``max_by`` / ``min_by`` where a column has no order, combine on the map side, so a hot
key sends one candidate per map task through the shuffle. A ranking window would send every row of the key to one task. A
64-bit hash leads the grouping columns: the sort below these aggregates then compares one long instead of texts or arrays.
Without it (``hashed=False``) like keys stay together, so far fewer bytes are shuffled, for more CPU in the sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _order(order: Sequence[str | Column]) -> Column:
    return F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])


def _comparable(kind: T.DataType) -> bool:
    """Whether values of a type can be ordered."""
    if isinstance(kind, T.StructType):
        return all(_comparable(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return _comparable(kind.elementType)
    return isinstance(kind, T.AtomicType) and not isinstance(kind, (T.VariantType, T.SpatialType))  # atomic, but without an order


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], pick, pick_by, hashed: bool) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    grouped = df.groupBy(*([F.xxhash64(*keys).alias("_h")] if hashed else []), *keys)
    named = [o for o in order if isinstance(o, str)]
    if len(named) == len(order) and set(named) <= set(rest) and all(_comparable(df.schema[c].dataType) for c in rest):
        # the order columns lead the row itself, so they are not carried a second time; ties go by the other columns
        best = grouped.agg(pick(F.struct(*named, *[c for c in rest if c not in named])).alias("_row"))
    else:
        best = grouped.agg(pick_by(F.struct(*rest), _order(order)).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], hashed: bool = True) -> DataFrame:
    """The row with the greatest order value per key."""
    return _pick(df, keys, order, F.max, F.max_by, hashed)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], hashed: bool = True) -> DataFrame:
    """The row with the smallest order value per key."""
    return _pick(df, keys, order, F.min, F.min_by, hashed)
