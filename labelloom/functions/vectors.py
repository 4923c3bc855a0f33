"""Vector columns stored as arrays of floats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def l2_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(vector: Column) -> Column:
    """Scale to unit length in float32; a zero vector stays zero."""
    norm = F.greatest(l2_norm(vector), F.lit(1e-12))
    return F.transform(vector, lambda x: (x.cast("double") / norm).cast("float"))
