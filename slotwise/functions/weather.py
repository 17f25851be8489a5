"""Bins, bands and interactions of weather and waits."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from slotwise.functions.calendar import c, flag

# Edges, labels and codes of the published features.
TEMP_EDGES = [0, 5, 10, 15, 20, 25, 30, 100]
TEMP_LABELS = ["very_cold", "cold", "cool", "mild", "warm", "hot", "very_hot"]
RAIN_EDGES = [0, 0.001, 1, 2.5, 5, 100]
RAIN_LABELS = ["none", "light", "moderate", "heavy", "extreme"]
WEATHER_CODES = {
    "Clear": [0], "Partly Cloudy": [1, 2, 3], "Foggy": [45, 48], "Drizzle": [51, 53, 55, 56, 57],
    "Rain": [61, 63, 65, 66, 67], "Snow": [71, 73, 75, 77], "Rain Showers": [80, 81, 82], "Thunderstorm": [95],
}
DEFAULT_TEMPERATURE, DEFAULT_RAIN = 20.0, 0.0
RAIN_INDICATOR_MM = 0.1
SEVERITY = [(0, "none"), (15, "short"), (30, "medium"), (60, "long")]


def right_closed_bin(x: str | Column, edges: Sequence[float], labels: Sequence[str], include_lowest: bool = False) -> Column:
    """Label of (lo, hi]; NULL outside. The lowest edge itself counts only if asked for."""
    x = c(x)
    out = None
    for i, label in enumerate(labels):
        above = (x >= edges[i]) if include_lowest and i == 0 else (x > edges[i])
        cond = above & (x <= edges[i + 1])
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out


def temp_bin(t: str | Column) -> Column:
    return right_closed_bin(t, TEMP_EDGES, TEMP_LABELS)


def rain_intensity(r: str | Column, zero_is_none: bool = False) -> Column:
    """Exact zero lies outside the first bin unless ``zero_is_none``."""
    return right_closed_bin(r, RAIN_EDGES, RAIN_LABELS, include_lowest=zero_is_none)


def weather_flags(temp: str | Column, rain: str | Column) -> dict[str, Column]:
    t, r = c(temp), c(rain)
    return {
        "has_rain": flag(r > 0), "any_rain": flag(r > 0), "heavy_rain": flag(r > 5), "temp_squared": t * t,
        "high_temp": flag(t > 25), "moderate_temp": flag(t.between(15, 25)), "low_temp": flag(t < 15),
    }


def interactions(temp: str | Column, rain: str | Column, weekend: Column, hour: Column, morning: Column, afternoon: Column) -> dict[str, Column]:
    return {
        "temp_weekend": c(temp) * weekend, "rain_weekend": c(rain) * weekend, "weekend_hour": hour * weekend,
        "weekend_morning": weekend * morning, "weekend_afternoon": weekend * afternoon,
    }


def condition(code: str | Column) -> Column:
    out = None
    for label, codes in WEATHER_CODES.items():
        cond = c(code).isin(codes)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise("Unknown")


def rain_indicator(mm: str | Column) -> Column:
    return F.when(c(mm) > RAIN_INDICATOR_MM, 1.0).otherwise(0.0)


def severity(wait: str | Column, is_open: Column | None = None) -> Column:
    """Band of a wait; no band while closed."""
    w = c(wait)
    out = F.when(w <= SEVERITY[0][0], SEVERITY[0][1])
    for hi, label in SEVERITY[1:]:
        out = out.when(w <= hi, label)
    out = out.when(w.isNotNull(), "very_long")
    return out if is_open is None else F.when(is_open, out)


def clip(x: str | Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Into [lo, hi]; NULL stays NULL."""
    x = c(x)
    e = x
    if lo is not None:
        e = F.greatest(e, F.lit(float(lo)))
    if hi is not None:
        e = F.least(e, F.lit(float(hi)))
    return F.when(x.isNotNull(), e)


def truth_int(x: str | Column) -> Column:
    """'True'/'False' text, booleans and numbers as 0/1."""
    s = F.lower(c(x).cast("string"))
    return F.when(s.isin("true", "1", "1.0"), 1).when(s.isin("false", "0", "0.0"), 0)
