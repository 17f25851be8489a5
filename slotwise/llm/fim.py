"""Fill-in-the-middle: every document is cut at two points of its text and its parts are put into another order.

Cut points are counted in code points and looked up in the text's UTF-8 bytes: the bytes of a batch are
viewed as 64-bit words; word arithmetic marks each byte that ends a code point (the next byte is no
continuation byte ``10xxxxxx``); ``bitwise_count`` and a running sum give the code points before each word,
a binary search finds the word of a cut, and byte-wise sums of that one word find the byte. Only lengths and
offsets leave Python; the parts are joined by binary substrings in the JVM.
"""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.llm.words import text_buffers

#: Marks of prefix, suffix and middle; shares (in 100) of documents that are cut, and of those with the suffix first.
MARKS, CUT, SUFFIX_FIRST = ("<P>", "<S>", "<M>"), 90, 20
#: Bytes of text whose words are held at a time (a longer text is handled alone).
BLOCK = 1 << 23
_LOW, _HIGH = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)


class Units:
    """Code points of consecutive texts; text i has the bytes ``off[i]`` to ``off[i + 1]``."""

    def __init__(self, raw: np.ndarray, off: np.ndarray):
        self.start = off - off[0]
        n = int(self.start[-1])
        padded = np.zeros((n + 7) // 8 * 8 + 8, np.uint8)
        padded[:n] = raw[off[0] : off[-1]]
        w = padded.view("<u8")
        follows = (w >> np.uint64(7)) & ~(w >> np.uint64(6)) & _LOW
        ends = ~((follows[:-1] >> np.uint64(8)) | (follows[1:] << np.uint64(56))) & _LOW
        last = self.start[1:][np.diff(self.start) > 0] - 1  # a text's last byte ends a unit, whatever comes after it
        np.bitwise_or.at(ends, last >> 3, np.uint64(1) << (8 * (last & 7)).astype(np.uint64))
        if n & 7:
            ends[-1] &= np.uint64((1 << 8 * (n & 7)) - 1)
        self.ends = ends
        self.before = np.zeros(len(ends) + 1, np.int64)
        np.cumsum(np.bitwise_count(ends), out=self.before[1:])
        self.first = self._count(self.start)
        self.n = np.diff(self.first)

    def _count(self, at: np.ndarray) -> np.ndarray:
        """Units that end before byte ``at``."""
        word = at >> 3
        inside = np.r_[self.ends, np.uint64(0)][word] & ((np.uint64(1) << (8 * (at & 7)).astype(np.uint64)) - np.uint64(1))
        return self.before[word] + np.bitwise_count(inside)

    def bytes_of(self, units: np.ndarray) -> np.ndarray:
        """Bytes taken by the first ``units[i]`` code points of text i."""
        if not len(self.ends):
            return np.zeros(len(units), np.int64)
        rank = self.first[:-1] + units
        word = np.minimum(np.searchsorted(self.before[1:], rank, "left"), len(self.ends) - 1)
        left = np.maximum(rank - self.before[word], 1).astype(np.uint64)
        sums = self.ends[word] * _LOW  # byte j: units ending in bytes 0 to j
        below = ~((sums | _HIGH) - left * _LOW) & _HIGH  # bytes whose sum is less than ``left``
        end = word * 8 + np.bitwise_count(below) + 1
        return np.where(units > 0, end - self.start[:-1], 0)


def cuts(text: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
    """Per text: its code points n, the smaller and larger of x mod (n + 1) and y mod (n + 1), and the bytes before either."""
    raw, off = text_buffers(text)
    x, y = (a.to_numpy(zero_copy_only=False).astype(np.int64) for a in (x, y))
    out, lo = [np.zeros((5, 0), np.int64)], 0
    while lo < len(off) - 1:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + BLOCK, "right")) - 1)
        u = Units(raw, off[lo : hi + 1])
        p, q = x[lo:hi] % (u.n + 1), y[lo:hi] % (u.n + 1)
        a, b = np.minimum(p, q), np.maximum(p, q)
        out.append(np.stack([u.n, a, b, u.bytes_of(a), u.bytes_of(b)]))
        lo = hi
    return pa.StructArray.from_arrays([pa.array(v) for v in np.concatenate(out, axis=1)], names=["n", "a", "b", "a_byte", "b_byte"])


def _draw(digest: Column, k: int) -> Column:
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, marks: tuple[str, str, str] = MARKS, cut: int = CUT, suffix_first: int = SUFFIX_FIRST
) -> DataFrame:
    """One row per document: id, ``n`` code points, ``form``, ``prefix_chars``, ``middle_chars``, ``output``.

    All draws come from the sha256 of ``seed:id``, so a repeated task or run gives the same rows. ``form`` is
    ``plain`` (the text as it is) for empty texts, texts that contain a mark and a share of the others, else
    ``psm`` (prefix, suffix, middle) or ``spm`` (suffix, prefix, middle). Null texts are empty; a null id is hashed
    as an empty one; rows with one id get the same draws; other columns are ignored; an empty table gives no rows.
    Bytes that are not UTF-8 are kept and counted by the same rule.
    """
    p, s, m = (F.lit(x).cast("binary") for x in marks)
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("given"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.sha2(F.concat(F.lit(f"{seed}:"), ident).cast("binary"), 256).alias("h"))
    locate = F.arrow_udf(cuts, "n long, a long, b long, a_byte long, b_byte long")
    rows = rows.withColumn("c", locate("text", _draw(F.col("h"), 0), _draw(F.col("h"), 1)))
    plain = (F.col("text") == "") | (_draw(F.col("h"), 2) % 100 >= cut)
    for x in marks:
        plain = plain | F.contains("text", F.lit(x))
    rows = rows.withColumn("form", F.when(plain, "plain").when(_draw(F.col("h"), 3) % 100 < suffix_first, "spm").otherwise("psm"))
    raw, a, b = F.col("text").cast("binary"), F.col("c.a_byte").cast("int"), F.col("c.b_byte").cast("int")
    prefix, middle, suffix = F.substring(raw, F.lit(1), a), F.substring(raw, a + 1, b - a), F.substring(raw, b + 1, F.octet_length("text"))
    output = F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle).cast("string")).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle).cast("string")).otherwise(F.col("text"))
    shown = F.col("form") != "plain"
    return rows.select(
        F.col("given").alias(id_col), F.col("c.n").alias("n"), "form", F.when(shown, F.col("c.a")).alias("prefix_chars"), F.when(shown, F.col("c.b") - F.col("c.a")).alias("middle_chars"), output.alias("output")
    )


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text again. A text that was cut contains no mark, so the marks of the output are the only ones."""
    parts = F.split(output, "|".join(re.escape(x) for x in marks), -1)
    psm = F.concat(parts[1], parts[3], parts[2])
    return F.when(form == "psm", psm).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def digest(rows: DataFrame, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """``output`` replaced by its sha256 and that of the text rebuilt from it."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    keep = [c for c in rows.columns if c != "output"]
    return rows.select(*keep, sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"), marks)).alias("restored_sha256"))
