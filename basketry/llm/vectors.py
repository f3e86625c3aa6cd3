"""Embedding vectors as whole numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: whole numbers below this keep sums of 4,096 squared differences within 64 bits
LIMIT = 1 << 24


def whole_vectors(df: DataFrame, vector: str, scale: int, columns: dict[str, Column]) -> DataFrame:
    """Rows with a whole, finite vector: ``columns`` and ``vector`` as floor(scale * x) of each component.

    Null vectors and those with a null or non-finite component are left out.  A
    scaled component of 2^24 or more stops the job, as distances would not fit
    a 64-bit number.
    """
    given = F.col(vector).cast("array<double>")
    finite = F.forall(given, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    too_large = F.raise_error(F.lit(f"a vector component is too large: {scale} times it is 2^24 or more"))
    whole = F.transform(
        given, lambda x: F.when(F.abs(x * scale) < LIMIT, F.floor(x * scale).cast("int")).otherwise(too_large.cast("int"))
    )
    kept = df.where(F.col(vector).isNotNull() & finite)
    return kept.select(*[c.alias(name) for name, c in columns.items()], whole.alias("vector"))


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """An Arrow list column of equally long lists as 64-bit rows."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def floor_means(sums: np.ndarray, counts: np.ndarray, old: np.ndarray) -> np.ndarray:
    """floor(sum / count) of each row; the old row where the count is 0."""
    return np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], old)
