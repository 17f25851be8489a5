"""Fixed-length sequences and one-hot sets."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from slotwise.functions.calendar import c


def pad_sequence(seq: str | Column, n: int, fill: Column) -> Column:
    """Last ``n`` elements, padded in front with ``fill``."""
    seq = c(seq)
    last = F.slice(seq, F.greatest(F.size(seq) - n + 1, F.lit(1)), F.lit(n))
    return F.concat(F.array_repeat(fill, F.greatest(F.lit(n) - F.size(seq), F.lit(0))), last)


def shift_append(seq: str | Column, new: Column) -> Column:
    """Without the oldest element, with ``new`` at the end."""
    seq = c(seq)
    return F.concat(F.slice(seq, F.lit(2), F.greatest(F.size(seq) - 1, F.lit(0))), F.array(new))


def one_hot(value: str | Column, categories: Sequence[str], prefix: str) -> dict[str, Column]:
    """0/1 column per category; unknown values are 0 everywhere."""
    v = c(value)
    return {f"{prefix}{k}": F.coalesce((v == k).cast("int"), F.lit(0)) for k in categories}


def one_hot_label(columns: Sequence[str], prefix: str) -> Column:
    """Name of the largest one-hot column without its prefix; the first one on ties."""
    pairs = [F.struct(F.col(n).cast("double").alias("v"), F.lit(-i).alias("o"), F.lit(n[len(prefix):]).alias("n")) for i, n in enumerate(columns)]
    return F.array_max(F.array(*pairs))["n"]
