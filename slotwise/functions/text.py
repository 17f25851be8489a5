"""Entity names as join keys, and stored timestamp keys."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slotwise.functions.calendar import c

# Fixed patterns: keys must equal those of stored data.
KEY_FORMAT = "yyyyMMddHHmmss"
KEY_FORMAT_MICROS = "yyyyMMddHHmmssSSSSSS"


def training_key(name: str | Column) -> Column:
    """Lower case without anything but letters, digits and white space; double spaces stay."""
    return F.regexp_replace(F.lower(c(name)), r"[^a-z0-9\s]", "")


def service_key(name: str | Column) -> Column:
    """Snake case; empty and missing names become ``unknown_ride``."""
    s = F.regexp_replace(F.lower(c(name)), r"(?U)[\s\-–—]+", "_")
    s = F.regexp_replace(s, r"(?U)[^\w]", "_")
    s = F.regexp_replace(F.regexp_replace(s, "_+", "_"), "^_|_$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("unknown_ride"))


def display_key(name: str | Column) -> Column:
    """Comparable form of displayed names: dashes unified, quotes and ! dropped, sponsor cut."""
    s = F.trim(F.lower(c(name)))
    s = F.regexp_replace(s, "[–—−]", "-")
    s = F.regexp_replace(s, "['’‘`´!]", "")
    s = F.regexp_replace(F.regexp_replace(s, r"\s+", " "), r"\s*-\s*", "-")
    s = F.regexp_replace(s, r"^the\s+", "")
    return F.trim(F.regexp_replace(s, r"\s+powered\s+by\s+.*", ""))


def apply_aliases(name: str | Column, aliases: dict[str, str]) -> Column:
    """Known aliases to their canonical name. For a large table use a join instead."""
    name = c(name)
    pairs = [F.lit(x) for kv in aliases.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), name), name)


def stamp_key(ts: str | Column, micros: bool = False) -> Column:
    return F.date_format(c(ts), KEY_FORMAT_MICROS if micros else KEY_FORMAT)


def parse_stamp_key(key: str | Column) -> Column:
    """Time back from the first 14 digits; NULL when they are no time."""
    return F.try_to_timestamp(F.substring(c(key), 1, 14), F.lit(KEY_FORMAT)).cast("timestamp_ntz")


def title_text(snake: str | Column) -> Column:
    return F.initcap(F.replace(c(snake), F.lit("_"), F.lit(" ")))
