"""Two-level scans: running values over a key's whole history without one task per key.

A window partitioned by the entity alone puts the hottest entity into one task. These
primitives cut each entity's history into chunks and work inside the chunks in parallel. What
a chunk needs from its neighbours is one summary row per chunk. That row is unioned to the
data and travels in the same shuffle, ahead of (or behind) the chunk's own rows, so nothing
is joined back.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.columns import as_list, attach, micros
from slotwise.session import stored

_CHUNK, _HOME, _KIND = "_chunk", "_home", "_kind"
_BEFORE, _DATA, _AFTER = 0, 1, 2
#: Rows of a key in one day above which the day is split.
CHUNK_ROWS = 200_000


def day_chunk(ts: str) -> Column:
    return F.to_date(F.col(ts))


def with_even_chunks(df: DataFrame, keys: Sequence[str], ts: str, rows: int = CHUNK_ROWS, most: int = 128) -> DataFrame:
    """``df`` with the chunk of each row: its day, or for days with more than ``rows`` rows of a key one of up to ``most`` stretches of about equal row counts.

    The starts of the stretches come from counts per minute, so rows of one minute stay together. Only days
    that are split enter the join, a table that is stored first so that its size is known.
    """
    day = F.date_trunc("day", F.col(ts)).cast("timestamp_ntz")
    if df.groupBy(*keys, day.alias("_day")).count().where(F.col("count") > rows).isEmpty():
        return df.withColumn(_CHUNK, day)
    cells = df.groupBy(*keys, day.alias("_day"), F.date_trunc("minute", F.col(ts)).cast("timestamp_ntz").alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys, "_day")
    before = F.coalesce(F.sum("_n").over(w.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumns({"_before": before, "_total": F.sum("_n").over(w)}).where(F.col("_total") > rows)
    piece = F.floor(F.col("_before") / F.greatest(F.lit(rows), F.col("_total") / most))
    starts = cells.groupBy(*keys, "_day", piece.alias("_piece")).agg(F.min("_cell").alias("_cell"))
    split = stored(starts.groupBy(*keys, "_day").agg(F.collect_list("_cell").alias("_starts")), "chunks")
    d = attach(df.withColumn("_day", day), split, [*keys, "_day"])
    begun = F.array_max(F.filter("_starts", lambda s: s <= F.col(ts)))
    return d.withColumn(_CHUNK, F.coalesce(begun, F.col("_day"))).drop("_day", "_starts")


def row_index(
    df: DataFrame,
    keys: str | Sequence[str],
    order: str | Sequence[str],
    chunk: Column,
    out: str = "row_idx",
    total: str | None = None,
) -> DataFrame:
    """0-based position of each row within its key, ordered by ``order``.

    ``chunk`` must be non-decreasing along ``order``. The row count of all earlier chunks of
    the key comes as the first row of each chunk.
    """
    keys = as_list(keys)
    d = df.withColumn(_CHUNK, chunk)
    sizes = d.groupBy(*keys, _CHUNK).agg(F.count(F.lit(1)).alias("_n"))
    w2 = Window.partitionBy(*keys)
    heads = sizes.select(
        *keys,
        _CHUNK,
        F.coalesce(F.sum("_n").over(w2.orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum("_n").over(w2).alias("_tot"),
        F.lit(_BEFORE).alias(_KIND),
    )
    u = d.withColumn(_KIND, F.lit(_DATA)).unionByName(heads, allowMissingColumns=True)
    w = Window.partitionBy(*keys, _CHUNK).orderBy(_KIND, *as_list(order))
    sofar = w.rowsBetween(Window.unboundedPreceding, 0)
    # the head is row 1 of its chunk, so the first data row is row 2
    u = u.withColumn(out, F.first("_off").over(sofar) + F.row_number().over(w) - 2)
    if total:
        u = u.withColumn(total, F.first("_tot").over(sofar))
    return u.where(F.col(_KIND) == _DATA).drop(_CHUNK, _KIND, "_off", "_tot")


def carry(
    df: DataFrame,
    keys: str | Sequence[str],
    ts: str,
    before: dict[str, str] | None = None,
    after: dict[str, str] | None = None,
    chunk: Column | None = None,
    inclusive: bool = True,
    order: Sequence[str] = (),
    even: int | None = None,
) -> DataFrame:
    """Nearest non-null values behind and ahead of each row, without limit of distance.

    ``before`` and ``after`` map input columns to output columns; ``inclusive`` counts the
    row itself. Each chunk starts with the last values of all earlier chunks and ends with
    the first values of all later ones. ``order`` settles equal stamps. With ``even`` days
    of more rows than that are split (``with_even_chunks``): for raw readings, which a key may pile up in one day.
    """
    keys, before, after = as_list(keys), before or {}, after or {}
    d = with_even_chunks(df, keys, ts, even) if even else df.withColumn(_CHUNK, day_chunk(ts) if chunk is None else chunk)
    at = lambda c: F.when(F.col(c).isNotNull(), F.struct(ts, *order))
    ends = d.groupBy(*keys, _CHUNK).agg(
        *[F.max_by(c, at(c)).alias(f"_z_{c}") for c in before], *[F.min_by(c, at(c)).alias(f"_a_{c}") for c in after]
    )
    w2 = Window.partitionBy(*keys).orderBy(_CHUNK)
    past, coming = w2.rowsBetween(Window.unboundedPreceding, -1), w2.rowsBetween(1, Window.unboundedFollowing)
    ends = ends.withColumns(
        {
            **{f"_z_{c}": F.last(f"_z_{c}", ignorenulls=True).over(past) for c in before},
            **{f"_a_{c}": F.first(f"_a_{c}", ignorenulls=True).over(coming) for c in after},
        }
    )
    u = d.withColumn(_KIND, F.lit(_DATA))
    for kind, cols, p in ((_BEFORE, before, "z"), (_AFTER, after, "a")):
        if cols:
            rows = ends.select(*keys, _CHUNK, *[F.col(f"_{p}_{c}").alias(c) for c in cols], F.lit(kind).alias(_KIND))
            u = u.unionByName(rows, allowMissingColumns=True)
    w = Window.partitionBy(*keys, _CHUNK).orderBy(_KIND, ts, *order)
    edge = 0 if inclusive else 1
    behind, ahead = w.rowsBetween(Window.unboundedPreceding, -edge), w.rowsBetween(edge, Window.unboundedFollowing)
    u = u.withColumns(
        {
            **{o: F.last(c, ignorenulls=True).over(behind) for c, o in before.items()},
            **{o: F.first(c, ignorenulls=True).over(ahead) for c, o in after.items()},
        }
    )
    return u.where(F.col(_KIND) == _DATA).drop(_CHUNK, _KIND)


def carry_forward(df: DataFrame, keys: str | Sequence[str], ts: str, cols: dict[str, str], **kw) -> DataFrame:
    """Last non-null value of each column up to the row."""
    return carry(df, keys, ts, before=cols, **kw)


def carry_backward(df: DataFrame, keys: str | Sequence[str], ts: str, cols: dict[str, str], **kw) -> DataFrame:
    """First non-null value of each column from the row onwards."""
    return carry(df, keys, ts, after=cols, **kw)


def as_of(
    left: DataFrame, right: DataFrame, keys: str | Sequence[str], ts: str, cols: dict[str, str], strict: bool = False, even: int | None = None
) -> DataFrame:
    """Last non-null values of ``right`` at or before (``strict``: before) each row of ``left``.

    Both sides meet in one union ordered by time: no range join, no join back. Of several
    right rows with one stamp the greatest counts. ``even`` as in ``carry``.
    """
    keys = as_list(keys)
    r = right.select(*keys, ts, *[F.col(c).alias(f"_r_{c}") for c in cols], F.lit(1 if strict else 0).alias("_side"))
    u = left.withColumn("_side", F.lit(0 if strict else 1)).unionByName(r, allowMissingColumns=True)
    out = carry_forward(
        u, keys, ts, {f"_r_{c}": f"_o_{o}" for c, o in cols.items()}, order=["_side", *[f"_r_{c}" for c in cols]], even=even
    )
    out = out.where(F.col("_side") == (0 if strict else 1))
    return out.select(*left.columns, *[F.col(f"_o_{o}").alias(o) for o in cols.values()])


def over_previous_rows(
    df: DataFrame,
    keys: str | Sequence[str],
    order: str | Sequence[str],
    back: int,
    exprs: Callable[[Window], dict[str, Column]],
    chunk: Column,
    block: int | None = None,
) -> DataFrame:
    """Row-count frames reaching at most ``back`` rows behind, computed in blocks.

    Rows get a position per key, positions are cut into blocks, and the last ``back`` rows
    of a block are copied into the next one, so every frame is complete inside its block.
    ``exprs`` receives the block's window (keys and block, ordered by position).
    """
    keys = as_list(keys)
    size = block or max(4096, 4 * back)
    if back > size:
        raise ValueError("block must be at least as long as the frame")
    d = row_index(df, keys, order, chunk, "row_idx")
    return _in_blocks(d, keys, F.col("row_idx"), size, back, exprs, lambda w: w.orderBy("row_idx"))


def over_previous_time(
    df: DataFrame,
    keys: str | Sequence[str],
    ts: str,
    seconds: int,
    exprs: Callable[[Window], dict[str, Column]],
) -> DataFrame:
    """Trailing time frame (t - seconds, t], open on the left, computed in blocks.

    A block is at least as long as the frame, so copying each row into the following block
    when it lies in its last ``seconds`` completes every frame.
    """
    keys = as_list(keys)
    reach = seconds * 1_000_000
    d = df.withColumn("_us", micros(ts))
    frame = lambda w: w.orderBy("_us").rangeBetween(-reach + 1, 0)
    return _in_blocks(d, keys, F.col("_us"), max(86_400_000_000, reach), reach, exprs, frame).drop("_us")


def trailing_time_mean(df: DataFrame, keys: str | Sequence[str], ts: str, y: str, seconds: int, out: str, even: int = CHUNK_ROWS) -> DataFrame:
    """Mean of ``y`` over the rows of the key in (t - seconds, t], NULL if there is none.

    Every row arrives at its stamp and leaves ``seconds`` later, as a second, slim row with the sign turned. The
    frame's sum and count are then running totals of arrivals and departures up to t, taken in even
    chunks that start with the totals of all chunks before them; the length of the frame plays no part.
    """
    keys = as_list(keys)
    d = df.withColumns({"_y": F.col(y).cast("double"), "_m": F.col(y).isNotNull().cast("long"), _KIND: F.lit(_DATA)})
    gone = df.where(F.col(y).isNotNull()).select(*keys, (F.col(ts) + F.make_dt_interval(secs=F.lit(seconds))).alias(ts), (-F.col(y).cast("double")).alias("_y"), F.lit(-1).cast("long").alias("_m"), F.lit(_AFTER).alias(_KIND))
    u = with_even_chunks(d.unionByName(gone, allowMissingColumns=True), keys, ts, even)
    totals = u.groupBy(*keys, _CHUNK).agg(F.sum("_y").alias("_y"), F.sum("_m").alias("_m"))
    past = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    heads = totals.select(*keys, _CHUNK, F.sum("_y").over(past).alias("_y"), F.sum("_m").over(past).alias("_m"), F.lit(_BEFORE).alias(_KIND))
    u = u.unionByName(heads, allowMissingColumns=True)
    # heads carry no stamp and come first; rows of one stamp count together
    w = Window.partitionBy(*keys, _CHUNK).orderBy(F.col(ts).asc_nulls_first()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    mean = F.when(F.sum("_m").over(w) > 0, F.sum("_y").over(w) / F.sum("_m").over(w))
    return u.withColumn(out, mean).where(F.col(_KIND) == _DATA).drop("_y", "_m", _KIND, _CHUNK)


def _in_blocks(d: DataFrame, keys: list[str], pos: Column, size: int, reach: int, exprs, frame) -> DataFrame:
    spill = F.pmod(pos, F.lit(size)) >= size - reach
    d = d.withColumn(_HOME, F.floor(pos / size))
    homes = F.when(spill, F.array(F.col(_HOME), F.col(_HOME) + 1)).otherwise(F.array(F.col(_HOME)))
    d = d.withColumn(_CHUNK, F.explode(homes))
    d = d.withColumns(exprs(frame(Window.partitionBy(*keys, _CHUNK))))
    return d.where(F.col(_CHUNK) == F.col(_HOME)).drop(_CHUNK, _HOME)
