"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are lower-cased in A-Z; a window is 10 consecutive words of an item (the whole item if it has fewer).
Winnowing hashes every 8 consecutive words and keeps the smallest hash of every 3 such neighbours, so any shared
window of 10 words leaves a common fingerprint. A shorter item leaves the hash of its whole sequence.
Fingerprints of documents (each kept hash once per run of positions) are joined with those of the
items; around each hit the window texts themselves are compared, so nothing is reported that is not there.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import maybe_broadcast, stored

WINDOW, GRAM = 10, 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK, _BREAK_ANY_CASE = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text; a null has none."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(low, _BREAK), "")


def _joined(df: DataFrame, a: str, i: int, b: str, j: int, out: str, how) -> DataFrame:
    """Column ``out``: values over i + j neighbours from those over i and over j."""
    n = F.greatest(F.least(F.size(a), F.size(b) - i), F.lit(0))
    return df.withColumn(out, F.zip_with(F.slice(a, 1, n), F.slice(b, i + 1, n), how))


def _spread(df: DataFrame, one: str, k: int, how, name: str) -> tuple[DataFrame, str]:
    """Values over k neighbours, by doubling."""
    have, width, col = {1: one}, 1, one
    while width * 2 <= k:
        df = _joined(df, col, width, col, width, f"{name}{width * 2}", how)
        width *= 2
        col = have[width] = f"{name}{width}"
    for part in sorted(have, reverse=True):
        while width + part <= k and width < k:
            df = _joined(df, col, width, have[part], part, f"{name}{width + part}", how)
            width += part
            col = f"{name}{width}"
    return df, col


def fingerprints(df: DataFrame, length: int) -> DataFrame:
    """Adds ``marks``: for each window of ``length`` words of column ``w`` its fingerprint, by start."""
    k = GRAM if length == WINDOW else length
    df = df.withColumn("h1", F.transform("w", lambda x: F.xxhash64(x)))
    df, grams = _spread(df, "h1", k, lambda x, y: F.xxhash64(x, y), "h")
    df, marks = _spread(df, grams, length - k + 1, lambda x, y: F.least(x, y), f"low{length}_")
    return df.withColumn("marks", F.col(marks))


def _runs(length: int) -> tuple[Column, Column]:
    """Each fingerprint once per run of starts [lo, hi) with the same one."""
    m = F.col("marks")
    opens = F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: (i == 0) | (F.get(m, i) != F.get(m, i - 1)))
    runs = F.transform(F.col("opens"), lambda s, j: F.struct(F.get(m, s).alias("mark"), F.lit(length).alias("len"), s.alias("lo"), F.coalesce(F.get(F.col("opens"), j + 1), F.size(m)).alias("hi")))
    return F.when(F.size(m) > 0, opens).otherwise(F.array().cast("array<int>")), runs


def _windows(w: Column, lo: Column, hi: Column, length: Column) -> Column:
    return F.transform(F.sequence(lo, hi - 1), lambda p: F.struct(length.alias("len"), p.alias("at"), F.array_join(F.slice(w, p + 1, length), " ").alias("seq")))


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``id, ver, n_hit, found`` (item ids) of the rows of ``docs(id, ver, text)`` that hold a window of ``items(item_id, text)``."""
    test = stored(items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0).withColumn("len", F.least(F.size("w"), F.lit(WINDOW))), "items")
    lengths = sorted(r.len for r in test.select("len").distinct().collect())  # at most WINDOW of them
    if not lengths:
        return docs.select("id", "ver").where("false").withColumns({"n_hit": F.lit(0), "found": F.array().cast("array<string>")})
    # outer: of a plain explode Spark infers a filter on the size of ``marks`` and expands its whole history below it
    marks = reduce(DataFrame.union, [fingerprints(test.where(F.col("len") == n), n).select(F.explode_outer("marks").alias("mark")) for n in lengths])
    marks = stored(marks.where("mark IS NOT NULL").distinct(), "marks")
    whole = stored(test.select("item_id", F.explode(_windows(F.col("w"), F.lit(0), F.size("w") - F.col("len") + 1, F.col("len"))).alias("x")).select("item_id", "x.len", "x.seq").distinct(), "windows")

    d = docs.select("id", "ver", words(F.col("text")).alias("w"))
    spots = []
    for n in lengths:
        opens, runs = _runs(n)
        spots.append(fingerprints(d, n).withColumn("opens", opens).select("id", "ver", F.inline(runs)))
    near = reduce(DataFrame.union, spots).join(maybe_broadcast(marks, 24), "mark", "left_semi")
    near = stored(near.groupBy("id", "ver").agg(F.collect_set(F.struct("len", "lo", "hi")).alias("runs")), "near")
    text = docs.join(maybe_broadcast(near, 40 + 16 * F.size("runs")), ["id", "ver"]).select("id", "ver", "runs", words(F.col("text")).alias("w"))
    seen = text.select("id", "ver", F.explode(F.flatten(F.transform("runs", lambda r: _windows(F.col("w"), r.lo, r.hi, r.len)))).alias("x")).select("id", "ver", "x.*")
    found = seen.join(maybe_broadcast(whole, 40 + F.octet_length("seq")), ["len", "seq"])
    places = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p.at, p.at + p.len - 1))))
    each = found.groupBy("id", "ver").agg(F.collect_set(F.struct("at", "len")).alias("places"), F.collect_set(F.col("item_id").cast("string")).alias("found"))
    return stored(each.select("id", "ver", F.size(places).alias("n_hit"), "found"), "hits")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("ver"))


def scan(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: id, ``n_words``, ``n_hit`` (words inside window occurrences), ``items`` (ids found, as sorted strings).

    Null and empty texts have no words, and items without words no windows. An item with a null id makes hits
    but is not listed. Rows with null or repeated ids are judged each on its own text. Other
    columns are ignored; an empty table gives an empty one.
    """
    d = _keyed(docs, id_col, text_col)
    h = hits(d.select("id", "ver", "text"), items.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text")))
    rows = d.select(F.col(f"row.`{id_col}`").alias(id_col), F.col("id").alias("__id"), F.col("ver").alias("__ver"), F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), _BREAK_ANY_CASE), "")).cast("long").alias("n_words"))
    out = rows.join(maybe_broadcast(h.toDF("__id", "__ver", "n_hit", "found"), 40 + 16 * F.size("found")), ["__id", "__ver"], "left")
    return out.select(id_col, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.array_sort("found"), F.array().cast("array<string>")).alias("items"))


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that hold no window of any item."""
    d = _keyed(docs, id_col, text_col)
    h = hits(d.select("id", "ver", "text"), items.select("item_id", "text"))
    return d.join(maybe_broadcast(h.select("id", "ver"), 32), ["id", "ver"], "left_anti").select("row.*")


def digest(result: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return result.select(id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
