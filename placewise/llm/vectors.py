"""Which rows of a vector column take part, shared by the vector operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components, and not zero."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def main_dimension(rows: DataFrame, column: str) -> int:
    """The length most vectors have (of equal counts the larger); 0 without rows."""
    top = rows.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return top.d if top else 0


def matrix(column, width: int) -> np.ndarray:
    """Rows of an Arrow list column, or of a column of arrays, as a double matrix."""
    if isinstance(column, (pa.Array, pa.ChunkedArray)):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    return np.stack(list(column)).astype(np.float64) if len(column) else np.zeros((0, width))


MOST = 1 << 23  # integers beyond it count as it, so that sums of products stay within a long


def integers(vector: Column) -> Column:
    """floor(256 * x) of each component, x as double, in longs."""
    return F.transform(vector.cast("array<double>"), lambda x: F.least(F.greatest(F.floor(x * 256), F.lit(-MOST)), F.lit(MOST)).cast("long"))


def finite(vector: Column) -> Column:
    """Not null, and without null or non-finite components; zero vectors and empty ones are finite."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
