"""Calendar columns: parts, bands, cyclic encodings, slot rounding, year shifts."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from slotwise.columns import micros


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def flag(cond: Column) -> Column:
    return F.when(cond, 1).otherwise(0)


def floor_to(ts: str | Column, minutes: int) -> Column:
    """Start of the slot holding ``ts``; keeps TIMESTAMP_NTZ."""
    ts = c(ts)
    day = F.date_trunc("day", ts)
    within = F.floor((F.hour(ts) * 60 + F.minute(ts)) / minutes) * minutes
    return (day + F.make_dt_interval(mins=within)).cast("timestamp_ntz")


def ceil_to(ts: str | Column, minutes: int) -> Column:
    ts = c(ts)
    down = floor_to(ts, minutes)
    return F.when(down == ts, down).otherwise(down + F.make_dt_interval(mins=F.lit(minutes)))


def time_key(ts: str | Column) -> Column:
    """Minutes since midnight."""
    ts = c(ts)
    return F.hour(ts) * 60 + F.minute(ts)


def day_time_key(ts: str | Column) -> Column:
    return F.weekday(c(ts)) * 1440 + time_key(ts)


def seconds_of_day(ts: str | Column) -> Column:
    ts = c(ts)
    return time_key(ts) * 60 + F.second(ts)


def hhmm_minutes(text: str) -> int:
    h, m = text.split(":")[:2]
    return int(h) * 60 + int(m)


def date_parts(ts: str | Column) -> dict[str, Column]:
    ts = c(ts)
    return {
        "year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts), "weekday": F.weekday(ts),
        "hour": F.hour(ts), "minute": F.minute(ts), "day_of_year": F.dayofyear(ts),
        "week": F.weekofyear(ts), "quarter": F.quarter(ts),
    }


# The bands below must match the series the models were built on.
PART_OF_DAY = [(6, 12, "morning"), (12, 17, "afternoon"), (17, 20, "evening")]
SIX_BANDS = [
    (6, 9, "early_morning"), (9, 12, "late_morning"), (12, 15, "early_afternoon"),
    (15, 18, "late_afternoon"), (18, 21, "early_evening"),
]
TIME_OF_DAY = [(12, 17, "afternoon"), (17, 20, "evening"), (20, 24, "night")]
SEASONS = {"winter": (12, 1, 2), "spring": (3, 4, 5), "summer": (6, 7, 8), "fall": (9, 10, 11)}
SHIFTED_SEASONS = {"spring": (4, 5, 6), "summer": (7, 8, 9), "fall": (10, 11, 12)}
FIRST_COVID_ERA = ("2020-05-20", "2020-11-01")
RECOVERY_ERA = ("2021-05-21", "2021-08-31")


def hour_band(hour: str | Column, bands: Sequence[tuple[int, int, str]], otherwise: str) -> Column:
    """Label of the left-closed hour band."""
    hour = c(hour)
    out = None
    for lo, hi, label in bands:
        cond = (hour >= lo) & (hour < hi)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(otherwise)


def part_of_day(ts: str | Column) -> Column:
    return hour_band(F.hour(c(ts)), PART_OF_DAY, "night")


def six_bands(ts: str | Column) -> Column:
    return hour_band(F.hour(c(ts)), SIX_BANDS, "night")


def time_of_day(ts: str | Column) -> Column:
    return hour_band(F.hour(c(ts)), TIME_OF_DAY, "morning")


def hour_bin(ts: str | Column) -> Column:
    """One-hour label such as 09:00-10:00 from 6 to 24 o'clock, else NULL."""
    h = F.hour(c(ts))
    return F.when(h >= 6, F.format_string("%02d:00-%02d:00", h, h + 1))


def season(ts: str | Column) -> Column:
    m = F.month(c(ts))
    out = None
    for label, months in SEASONS.items():
        out = F.when(m.isin(*months), label) if out is None else out.when(m.isin(*months), label)
    return out


def shifted_season_flags(ts: str | Column) -> dict[str, Column]:
    m = F.month(c(ts))
    return {f"is_{k}": flag(m.isin(*v)) for k, v in SHIFTED_SEASONS.items()}


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    angle = 2 * F.pi() * value / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def cyclic_features(ts: str | Column) -> dict[str, Column]:
    ts = c(ts)
    out: dict[str, Column] = {}
    for name, v, p in [
        ("month", F.month(ts), 12), ("hour", F.hour(ts), 24), ("weekday", F.weekday(ts), 7),
        ("minute", F.minute(ts), 60), ("doy", F.dayofyear(ts), 365.25),
    ]:
        out[f"{name}_sin"], out[f"{name}_cos"] = cyclic(v, p)
    return out


def inverse_cyclic(sin: str | Column, cos: str | Column, period: int, first: int = 0) -> Column:
    """Unit back from its sine and cosine; ``first`` is the lowest unit (1 for months)."""
    unit = F.pmod(F.bround(F.atan2(c(sin), c(cos)) * period / (2 * F.pi())).cast("int"), F.lit(period))
    return F.pmod(unit - first, F.lit(period)) + first


def same_weekday_last_year(ts: str | Column) -> Column:
    """One year back (29 Feb to 28 Feb), then shifted inside the week to the same weekday."""
    ts = c(ts)
    back = ts - F.expr("INTERVAL '1' YEAR")
    return back + F.make_dt_interval(days=F.weekday(ts) - F.weekday(back))


def day_flags(ts: str | Column) -> dict[str, Column]:
    ts = c(ts)
    wd, h, m = F.weekday(ts), F.hour(ts), F.month(ts)
    return {
        "is_weekend": flag(wd >= 5), "is_friday": flag(wd == 4), "is_sunday": flag(wd == 6),
        "is_peak_hour": flag(h.between(11, 16)), "is_opening_hour": flag(h.isin(9, 10)),
        "is_closing_hour": flag(h.isin(19, 20, 21)), "is_summer_vacation": flag(m.isin(6, 7, 8)),
        "morning_rush": flag(h.between(9, 11)), "lunch_time": flag(h.between(12, 14)),
        "afternoon_rush": flag(h.between(15, 17)), "evening": flag(h >= 18),
    }


def era_flags(ts: str | Column, eras: dict[str, tuple[str, str]] | None = None) -> dict[str, Column]:
    eras = eras or {"between_covid_lockdowns": FIRST_COVID_ERA, "covid_recovery": RECOVERY_ERA}
    ts = c(ts)
    return {
        k: flag(ts.between(F.lit(a).cast("timestamp_ntz"), F.lit(b).cast("timestamp_ntz"))) for k, (a, b) in eras.items()
    }


def to_local(ts: str | Column, zone: str) -> Column:
    """UTC wall clock to local wall clock (both TIMESTAMP_NTZ)."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), c(ts))


def to_utc(ts: str | Column, zone: str) -> Column:
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), c(ts))


def within_local_hours(ts: str | Column, zone: str, lo: str = "09:00", hi: str = "17:30") -> Column:
    return time_key(to_local(ts, zone)).between(hhmm_minutes(lo), hhmm_minutes(hi))


def age_text(ts: str | Column, now: str | Column) -> Column:
    """Age of a reading in words."""
    mins = F.floor((micros(c(now)) - micros(c(ts))) / 60_000_000)
    hours = F.floor(mins / 60)
    return (
        F.when(mins < 1, "Just updated")
        .when(mins == 1, "1 minute ago")
        .when(mins < 60, F.concat(mins.cast("string"), F.lit(" minutes ago")))
        .when(hours == 1, "1 hour ago")
        .otherwise(F.concat(hours.cast("string"), F.lit(" hours ago")))
    )
