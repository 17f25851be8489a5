"""Lookup forecasts: fit is an aggregation, predict is a join. All keys in one job."""
from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.columns import attach, micros
from slotwise.functions.calendar import day_time_key, same_weekday_last_year, time_key
from slotwise.operators.scans import as_of, day_chunk, over_previous_rows
from slotwise.session import stored

MODELS = (
    "mean", "time_of_day", "day_time", "moving_average", "seasonal_weekly", "holiday_aware", "last_week", "last_year",
)


class Baselines:
    """Forecasts for the rows of ``future`` from the rows of ``train``.

    Both hold key, time and measure; the result of every model is ``future`` with ``yhat``.
    """

    def __init__(self, key: str = "ride_name", ts: str = "timestamp", y: str = "wait_time", out: str = "yhat"):
        self.key, self.ts, self.y, self.out = key, ts, y, out

    # -- helpers
    def _global(self, train: DataFrame, name: str = "_g") -> DataFrame:
        return train.groupBy(self.key).agg(F.avg(self.y).alias(name))

    def _lookup(self, future: DataFrame, slots: dict[str, Column], fill: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Forecast that depends on the key and a few slot columns only.

        The distinct slots of the future (a small table) are completed by ``fill`` with the
        output column; the future rows then meet that table once.
        """
        d = future.withColumns(slots) if slots else future
        on = [self.key, *slots]
        table = stored(fill(d.select(*on).distinct()).select(*on, self.out), "slots")
        return attach(d, table, on).select(*future.columns, self.out)

    def _chain(self, train: DataFrame, future: DataFrame, levels: Sequence[dict[str, Column]]) -> DataFrame:
        """First level with a mean wins; levels go from specific to general.

        Training rows are summed once over the finest slots, the coarser means come from
        those sums.
        """
        slots = {k: e for lv in levels for k, e in lv.items()}
        fine = train.groupBy(self.key, *[e.alias(k) for k, e in slots.items()]).agg(
            F.sum(self.y).alias("_s"), F.count(self.y).alias("_c")
        )

        def fill(table: DataFrame) -> DataFrame:
            for i, lv in enumerate(levels):
                m = fine.groupBy(self.key, *lv).agg(F.try_divide(F.sum("_s"), F.sum("_c")).alias(f"_m{i}"))
                table = attach(table, m, [self.key, *lv])
            return table.withColumn(self.out, F.coalesce(*[F.col(f"_m{i}") for i in range(len(levels))]))

        return self._lookup(future, slots, fill)

    # -- models
    def mean(self, train: DataFrame, future: DataFrame) -> DataFrame:
        return self._chain(train, future, [{}])

    def time_of_day(self, train: DataFrame, future: DataFrame) -> DataFrame:
        return self._chain(train, future, [{"_tk": time_key(self.ts)}, {}])

    def day_time(self, train: DataFrame, future: DataFrame) -> DataFrame:
        return self._chain(train, future, [{"_dtk": day_time_key(self.ts)}, {"_tk": time_key(self.ts)}, {}])

    def _marked(self, df: DataFrame, holidays: DataFrame, date: str = "date") -> DataFrame:
        flag = holidays.select(F.col(date).alias("_d")).distinct().withColumn("_h", F.lit(True))
        j = df.withColumn("_d", F.to_date(self.ts)).join(flag, "_d", "left")
        return j.withColumn("_hol", F.coalesce("_h", F.lit(False))).drop("_d", "_h")

    def holiday_aware(self, train: DataFrame, future: DataFrame, holidays: DataFrame, date: str = "date") -> DataFrame:
        """Separate profiles for holidays and other days; the holiday table is an input."""
        cols = future.columns
        mark = lambda df: self._marked(df, holidays, date)
        hol = {"_hol": F.col("_hol")}
        levels = [
            {**hol, "_dtk": day_time_key(self.ts)}, {**hol, "_tk": time_key(self.ts)}, hol, {},
        ]
        return self._chain(mark(train), mark(future), levels).select(*cols, self.out)

    def moving_average(self, train: DataFrame, future: DataFrame, window: int = 48) -> DataFrame:
        """Mean of the last ``window`` training rows before t.

        The trailing mean is formed on training rows alone, then looked up as-of. With future
        rows inside the frame they would use up its places.
        """
        d = self._trailing(train, future, window)
        d = attach(d, self._global(train), [self.key])
        return d.select(*future.columns, F.coalesce("_ma", "_g").alias(self.out))

    def _trailing(self, train: DataFrame, future: DataFrame, window: int) -> DataFrame:
        def exprs(w):
            return {"_ma": F.avg(self.y).over(w.rowsBetween(-(window - 1), 0))}

        ma = over_previous_rows(
            train.where(F.col(self.y).isNotNull()).select(self.key, self.ts, self.y), self.key, self.ts, window, exprs, day_chunk(self.ts)
        ).select(self.key, self.ts, "_ma")
        return as_of(future, ma, self.key, self.ts, {"_ma": "_ma"}, strict=True)

    def seasonal_weekly(self, train: DataFrame, future: DataFrame, weeks: int = 4) -> DataFrame:
        """Mean of the newest ``weeks`` training rows with the same weekday and time."""
        def fill(table: DataFrame) -> DataFrame:
            t = attach(attach(table, self._weekly(train, weeks), [self.key, "_dtk"]), self._global(train), [self.key])
            return t.withColumn(self.out, F.coalesce("_s", "_g"))

        return self._lookup(future, {"_dtk": day_time_key(self.ts)}, fill)

    def _weekly(self, train: DataFrame, weeks: int) -> DataFrame:
        w = Window.partitionBy(self.key, "_dtk").orderBy(F.col(self.ts).desc())
        last = train.withColumn("_dtk", day_time_key(self.ts)).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= weeks)
        return last.groupBy(self.key, "_dtk").agg(F.avg(self.y).alias("_s"))

    def last_week(self, train: DataFrame, future: DataFrame, later: Sequence[DataFrame] = (), days: int = 7) -> DataFrame:
        """Exact value ``days`` earlier; where sources overlap the later source wins."""
        d = self._week_before(train, future, later, days)
        d = attach(d, self._global(train), [self.key])
        return d.select(*future.columns, F.coalesce("_v", "_g").alias(self.out))

    def _week_before(self, train: DataFrame, future: DataFrame, later: Sequence[DataFrame], days: int) -> DataFrame:
        sources = [s.select(self.key, self.ts, self.y, F.lit(i).alias("_p")) for i, s in enumerate([train, *later])]
        hist = reduce(DataFrame.unionByName, sources)
        hist = hist.groupBy(
            self.key, (F.col(self.ts) + F.make_dt_interval(days=F.lit(days))).alias(self.ts)
        ).agg(F.max_by(self.y, "_p").alias("_v"))
        return future.join(hist, [self.key, self.ts], "left")

    def last_year(self, train: DataFrame, future: DataFrame) -> DataFrame:
        """Value of the same weekday one year back, else the nearest one within seven days."""
        d = self._year_before(train, future)
        d = attach(d, self._global(train), [self.key])
        return d.select(*future.columns, F.coalesce("_y", "_g").alias(self.out))

    def _year_before(self, train: DataFrame, future: DataFrame) -> DataFrame:
        d = future.withColumn("_target", same_weekday_last_year(self.ts))
        hit = nearest_in_time(
            d.select(self.key, "_target").distinct(), train.select(self.key, self.ts, self.y), self.key, "_target", self.ts, self.y, "_y"
        )
        return d.join(hit, [self.key, "_target"], "left").drop("_target")

    def _profiles(self, train: DataFrame, slots: DataFrame, weeks: int) -> DataFrame:
        """``slots`` (key, ``_hol``, ``_dtk``, ``_tk``) with the means of every model that looks them up.

        One aggregation over the finest slots, one over grouping sets of its sums for all coarser means, and one
        join, in which a slot asks for each of its levels.
        """
        on = [self.key, "_hol", "_dtk", "_tk"]
        fine = train.groupBy(*on).agg(F.sum(self.y).alias("_s"), F.count(self.y).alias("_c"))
        # level: the columns summed over, as bits of (key, _hol, _dtk, _tk)
        levels = {0: on, 2: [self.key, "_hol", "_tk"], 3: [self.key, "_hol"], 4: [self.key, "_dtk", "_tk"], 6: [self.key, "_tk"], 7: [self.key]}
        means = fine.groupingSets([[F.col(c) for c in cols] for cols in levels.values()], *on).agg(
            F.grouping_id().cast("int").alias("_lv"), F.try_divide(F.sum("_s"), F.sum("_c")).alias("_m")
        )
        kinds = dict(slots.dtypes)
        asked = F.explode(F.array(*[F.struct(F.lit(lv).alias("lv"), *[(F.col(c) if c in cols else F.lit(None).cast(kinds[c])).alias(c) for c in on[1:]]) for lv, cols in levels.items()]))
        wide = slots.select(*[F.col(c).alias(f"_of{c}") for c in on], asked.alias("_a"))
        wide = wide.select(F.col(f"_of{self.key}").alias(self.key), *[f"_of{c}" for c in on[1:]], F.col("_a.lv").alias("_lv"), *[F.col(f"_a.{c}").alias(c) for c in on[1:]])
        found = attach(wide, means, [*on, "_lv"])
        back = found.groupBy(self.key, *[F.col(f"_of{c}").alias(c) for c in on[1:]]).agg(*[F.max(F.when(F.col("_lv") == lv, F.col("_m"))).alias(f"_m{lv}") for lv in levels])
        return attach(back, self._weekly(train, weeks), [self.key, "_dtk"])

    def all(self, train: DataFrame, future: DataFrame, holidays: DataFrame, done: DataFrame | None = None, weeks: int = 4, window: int = 48, days: int = 7) -> DataFrame:
        """Every model in long form; ``done`` (key, model) pairs are left out, so a broken run resumes.

        All means come from one pass over the training rows and meet the future rows in one join; the three
        models that look at single stamps add a column each; the columns are then turned into rows.
        """
        on = [self.key, "_hol", "_dtk", "_tk"]
        keyed = lambda df: self._marked(df, holidays).withColumns({"_dtk": day_time_key(self.ts), "_tk": time_key(self.ts)})
        d, past = keyed(future), keyed(train)
        d = attach(d, stored(self._profiles(past, d.select(*on).distinct(), weeks), "profiles"), on)
        d = self._trailing(train, d, window)
        d = self._week_before(train, d, (), days)
        d = self._year_before(train, d)
        m = {lv: F.col(f"_m{lv}") for lv in (0, 2, 3, 4, 6, 7)}
        values = {
            "mean": m[7], "time_of_day": F.coalesce(m[6], m[7]), "day_time": F.coalesce(m[4], m[6], m[7]), "moving_average": F.coalesce("_ma", m[7]),
            "seasonal_weekly": F.coalesce("_s", m[7]), "holiday_aware": F.coalesce(m[0], m[2], m[3], m[7]),
            "last_week": F.coalesce("_v", m[7]), "last_year": F.coalesce("_y", m[7]),
        }
        rows = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), values[n].alias(self.out)) for n in MODELS]))
        out = d.select(*future.columns, rows.alias("_r")).select(*future.columns, F.col(f"_r.{self.out}").alias(self.out), F.col("_r.model").alias("model"))
        if done is None:
            return out
        gone = done.select(F.col(self.key).alias("_k"), F.col("model").alias("_m"))
        return out.join(gone, F.col(self.key).eqNullSafe(F.col("_k")) & (F.col("model") == F.col("_m")), "left_anti")


def post_process(df: DataFrame, pred: str, closed: str | None = None) -> DataFrame:
    """No negative forecasts; zero while closed."""
    e = F.greatest(F.col(pred), F.lit(0.0))
    if closed:
        e = F.when(F.col(closed), F.lit(0.0)).otherwise(e)
    return df.withColumn(pred, e)


def nearest_in_time(
    targets: DataFrame,
    hist: DataFrame,
    key: str,
    target: str,
    ts: str,
    value: str,
    out: str,
    max_days: int = 7,
    weekday_bias_hours: int = 1,
) -> DataFrame:
    """Value nearest to each target stamp, same-weekday readings counted one hour nearer.

    Distance after the bias must stay below ``max_days``; the earlier reading wins ties. Four
    as-of lookups (before and after, any weekday and same weekday) hold the optimum, so no
    pairs are formed. History rows are copied to the neighbouring time blocks, which are
    longer than the reach.
    """
    size = (max_days + 1) * 86_400_000_000
    us = lambda c: micros(c)
    h = hist.where(F.col(value).isNotNull()).groupBy(key, ts).agg(F.max(value).alias("_hv"))
    h = h.select(
        key, us(ts).alias("_us"), F.weekday(ts).alias("_wd"), "_hv", F.lit(None).cast("timestamp_ntz").alias(target)
    ).withColumn("_blk", F.explode(F.array(*[F.floor(F.col("_us") / size) + i for i in (-1, 0, 1)])))
    t = targets.select(
        key, us(target).alias("_us"), F.weekday(target).alias("_wd"), F.lit(None).cast(hist.schema[value].dataType).alias("_hv"), target,
        F.floor(us(target) / size).alias("_blk"),
    )
    u = h.unionByName(t)
    seen = F.when(F.col("_hv").isNotNull(), F.struct(F.col("_us").alias("u"), F.col("_hv").alias("v"), F.col("_wd").alias("w")))
    u = u.withColumn("_s", seen)
    anyday = Window.partitionBy(key, "_blk").orderBy("_us")
    sameday = Window.partitionBy(key, "_blk", "_wd").orderBy("_us")
    looks = {
        "_b": F.last("_s", True).over(anyday.rangeBetween(Window.unboundedPreceding, 0)),
        "_a": F.first("_s", True).over(anyday.rangeBetween(0, Window.unboundedFollowing)),
        "_bw": F.last("_s", True).over(sameday.rangeBetween(Window.unboundedPreceding, 0)),
        "_aw": F.first("_s", True).over(sameday.rangeBetween(0, Window.unboundedFollowing)),
    }
    for n, e in looks.items():
        u = u.withColumn(n, e)
    q = u.where(F.col(target).isNotNull())
    bias = weekday_bias_hours * 3_600_000_000

    def cand(n):
        s = F.col(n)
        cost = F.abs(s["u"] - F.col("_us")) - F.when(s["w"] == F.col("_wd"), bias).otherwise(0)
        exact = F.when(s["u"] == F.col("_us"), 0).otherwise(1)
        return F.when(s.isNotNull() & (cost < max_days * 86_400_000_000), F.struct(exact, cost.alias("cost"), s["u"].alias("u"), s["v"].alias("v")))

    best = F.array_min(F.array_compact(F.array(*[cand(n) for n in looks])))
    return q.select(key, target, best["v"].alias(out))
