"""Row filters and column selection."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.columns import as_list, require
from slotwise.functions.calendar import c, floor_to
from slotwise.operators.grid import band


def filter_time_of_day(df: DataFrame, ts: str, lo: str, hi: str) -> DataFrame:
    return df.where(band(ts, lo, hi))


def drop_dates(df: DataFrame, ts: str, dates: Sequence[str] | DataFrame) -> DataFrame:
    """Dates as a short list or as a table with column ``date``."""
    if isinstance(dates, DataFrame):
        return df.withColumn("_d", F.to_date(ts)).join(dates.select(F.col("date").alias("_d")), "_d", "left_anti").select(*df.columns)
    return df.where(~F.to_date(ts).isin([F.lit(d).cast("date") for d in dates]))


def drop_months(df: DataFrame, ts: str, months: Sequence[int]) -> DataFrame:
    return df.where(~F.month(ts).isin(list(months)))


def drop_keys(df: DataFrame, key: str, contains: Sequence[str] = (), equals: Sequence[str] = ()) -> DataFrame:
    cond = F.col(key).isin(list(equals)) if equals else F.lit(False)
    for s in contains:
        cond = cond | F.col(key).contains(s)
    return df.where(~cond)


def meaningful(wait: str | Column, closed: str | Column) -> Column:
    """A wait above one minute, or a zero while open."""
    w = c(wait)
    return (w > 1) | ((w == 0) & ~c(closed))


def cap_filter(df: DataFrame, col: str, hi: float, keep_null: bool = True) -> DataFrame:
    cond = F.col(col) <= hi
    return df.where(F.col(col).isNull() | cond if keep_null else cond)


def exclude_period(df: DataFrame, ts: str, lo: str, hi: str) -> DataFrame:
    """Without ``lo`` to ``hi``, both included."""
    return df.where((F.col(ts) < F.lit(lo).cast("timestamp_ntz")) | (F.col(ts) > F.lit(hi).cast("timestamp_ntz")))


def open_only(df: DataFrame, closed: str = "closed") -> DataFrame:
    return df.where(~F.col(closed))


def on_bucket_edge(df: DataFrame, ts: str, minutes: int) -> DataFrame:
    return df.where(F.col(ts) == floor_to(ts, minutes))


def search_catalogue(
    df: DataFrame, text: str, columns: Sequence[str], category: str | None = None, category_col: str = "category"
) -> DataFrame:
    """Case-insensitive substring in any of the columns, within one category if given."""
    needle = text.strip().lower()
    hit = F.lit(False)
    for col in columns:
        hit = hit | F.coalesce(F.lower(F.col(col).cast("string")).contains(needle), F.lit(False))
    d = df.where(hit)
    return d.where(F.col(category_col) == category) if category else d


def wait_range(col: str | Column, edges: Sequence[float] = (0, 10, 30, 60)) -> Column:
    """Label of the left-closed range; the last one is open-ended."""
    col = c(col)
    out = None
    for lo, hi in zip(edges, [*edges[1:], None]):
        cond = (col >= lo) if hi is None else (col >= lo) & (col < hi)
        label = f"{lo:g}+" if hi is None else f"{lo:g}-{hi:g}"
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out


_NUMERIC = ("int", "bigint", "smallint", "tinyint", "double", "float")


def select_features(
    df: DataFrame, prefixes: Sequence[str] = (), numeric: bool = False, exclude: Sequence[str] = (), keep: Sequence[str] = ()
) -> DataFrame:
    """``keep`` first, then columns with a prefix or (``numeric``) a number type, without ``exclude``."""
    def wanted(name: str, dtype: str) -> bool:
        return any(name.startswith(p) for p in prefixes) or (numeric and dtype.split("(")[0] in (*_NUMERIC, "decimal"))

    cols = [n for n, t in df.dtypes if wanted(n, t) and n not in exclude and n not in keep]
    return df.select(*keep, *cols)


# Weekday names as numbers.
WEEKDAYS = {n: i for i, n in enumerate(["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"])}


def conform_features(df: DataFrame, expected: Sequence[str], size: int | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Columns in model order as doubles; missing ones raise, surplus ones go.

    Weekday names become 0-6, booleans 0/1, NULL 0.
    """
    names = list(expected)[: size or len(expected)]
    require(df, *names, *as_list(keep))
    types = dict(df.dtypes)
    names_map = F.create_map(*[F.lit(x) for kv in WEEKDAYS.items() for x in kv])

    def number(n: str) -> Column:
        if types[n] == "string":
            e = F.coalesce(F.try_element_at(names_map, F.col(n)).cast("double"), F.expr(f"try_cast(`{n}` AS double)"))
        elif types[n] == "boolean":
            e = F.col(n).cast("int").cast("double")
        else:
            e = F.col(n).cast("double")
        return F.coalesce(e, F.lit(0.0)).alias(n)

    return df.select(*keep, *[number(n) for n in names])
