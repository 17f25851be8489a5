"""Aggregates that give NULL instead of failing on constant groups."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slotwise.functions.calendar import c


def safe_corr(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation over complete pairs; NULL where a side does not vary."""
    x, y = c(x).cast("double"), c(y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.try_divide(F.covar_pop(x, y), spread)
