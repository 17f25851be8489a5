"""Normal noise that depends only on a seed and the row's key, not on partitions or retries."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _uniform(*cols: Column) -> Column:
    """In (0, 1]."""
    return (F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) + 1) / F.lit(float(1 << 52))


def standard_normal(seed: int, *key: Column) -> Column:
    u1 = _uniform(F.lit(seed), F.lit(1), *key)
    u2 = _uniform(F.lit(seed), F.lit(2), *key)
    return F.sqrt(-2.0 * F.ln(u1)) * F.cos(2 * F.pi() * u2)
