"""Exact Jaccard self-join of word-shingle sets by partitioning the token universe.

For J(R, S) >= t the symmetric difference has at most H = (1 - t) / (1 + t) * (|R| + |S|) shingles. Sets
are banded by size (ratio 1 / t, so partners lie in the same or the neighbouring band). A band
divides the universe of shingle hashes into m segments. Were each segment of R to differ from
that of S, H + 1 differences would be needed; so R needs only probe segments worth H + 1 units.

* A segment probed for equality counts one unit. In small bands (up to ``DELETION_SIZE`` shingles) a
  segment also carries its one-deletion neighbourhood (the segment without each one of its
  shingles); probed that way it counts two units, and half as many segments are enough.
* Large bands get a tenth more segments than units, to choose from.
* Allocation by cost: a segment that no other set shares costs nothing. A set whose free
  segments reach H + 1 units cannot have a partner and is dropped with all its keys. Else the
  cheapest shared segments (by number of sets that share them) fill the gap.

Sets with the same shingles are joined first, as one class. Each class is then verified against
the class it shares most keys with; only where sets of *different* components still share keys
(after a second allocation) are further pairs formed, those whose parity sketches do not already
prove them too different. So groups of many near copies do not expand into pairs, and every link
between different components is tested.

Shingles are compared by 64-bit hashes (see ``words``).
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import maybe_broadcast, stored
from slotwise.llm.graph import components
from slotwise.llm.words import Group, groups, mix

SHINGLE, PERCENT = 5, 80
#: Bands up to this size use one-deletion neighbourhoods: n + m keys a set there, but few and selective segments.
DELETION_SIZE = 24
_SEG, _TOK = np.uint64(0x2545F4914F6CDD1D), np.uint64(0xA24BAED4963EE407)


class Bands:
    """Size bands for a threshold in percent: lower sizes, upper sizes, segments and units a segment."""

    def __init__(self, percent: int):
        self.t = percent
        low, b = [], 0
        while not low or low[-1] < 1 << 31:
            low.append(-(-(100**b) // percent**b))
            b += 1
        self.low = np.array(low[:-1])
        self.high = np.array(low[1:]) - 1
        most = self.units(self.high * 100 // percent, self.high)
        self.weight = np.where(self.high <= DELETION_SIZE, 2, 1)
        self.segments = np.where(self.weight == 2, -(-most // 2), -(-most * 11 // 10))

    def units(self, n, partner):
        """One more than the differences that sets of these sizes may have."""
        return (n + partner) * (100 - self.t) // (100 + self.t) + 1

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, n, "right") - 1

    def columns(self, n: Column, own: Column) -> tuple[Column, Column, Column]:
        """Segments, units a segment and upper size of the band in which a set of size ``n`` has this role."""
        pick = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), index)
        index = F.size(F.filter(F.array(*[F.lit(int(v)) for v in self.low]), lambda x: x <= n)) - F.when(own, 0).otherwise(1)
        return pick(self.segments), pick(self.weight), pick(self.high)


def shingle_sets(g: Group, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document (within the group), hash of each distinct shingle in order, and set sizes by document."""
    at, h = g.grams(k)
    docs, size = g.docs(), np.diff(g.first)
    doc = docs[at]
    for short in range(1, k):
        if (size == short).any():
            a, x = g.grams(short)
            whole = (size[docs[a]] == short)
            doc, h = np.r_[doc, docs[a[whole]]], np.r_[h, x[whole]]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    if len(h):
        new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]
        doc, h = doc[new], h[new]
    return doc, h, np.bincount(doc, minlength=g.hi - g.lo)


def _set_ids(doc: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    total = np.zeros(len(n), np.uint64)
    np.add.at(total, doc, mix(h + _TOK))
    return mix(total + n.astype(np.uint64) * _SEG)


def _measure(k: int):
    def run(batches):
        for b in batches:
            n_all, id_all = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for g in groups(b.column("text"), lower=True):
                doc, h, n = shingle_sets(g, k)
                n_all.append(n)
                id_all.append(_set_ids(doc, h, n).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("given"), b.column("ver"), pa.array(np.concatenate(n_all).astype(np.int64)), pa.array(np.concatenate(id_all))], names=["given", "ver", "n", "sid"])

    return run


def _keys(k: int, bands: Bands):
    """Rows ``h`` (segment key), ``sid`` (set) and ``tag`` (size, segment, empty, own band)."""

    def rows(doc, h, n, sid, band, own):
        m = np.where(band >= 0, bands.segments[np.maximum(band, 0)], 0)
        m[n == 0] = 0
        base = np.r_[0, np.cumsum(m)]
        used = m[doc] > 0
        doc, h = doc[used], h[used]
        seg = (mix(h ^ (band[doc].astype(np.uint64) * _SEG)) % m[doc].astype(np.uint64)).astype(np.int64)
        cell, value = base[doc] + seg, mix(h ^ _TOK)
        content = np.zeros(base[-1], np.uint64)
        np.add.at(content, cell, value)
        filled = np.zeros(base[-1], np.int64)
        np.add.at(filled, cell, 1)
        of = np.repeat(np.arange(len(n)), m)
        number = np.arange(base[-1]) - base[of]
        salt = mix(band[of].astype(np.uint64) * _TOK + number.astype(np.uint64) * _SEG)
        tag = (n[of].astype(np.int64) << 32) | (number << 2) | ((filled == 0).astype(np.int64) << 1) | int(own)
        keys, of_key, tags = mix(content + salt), of, tag
        pairs = bands.weight[band[doc]] == 2 if len(doc) else np.zeros(0, bool)
        if pairs.any():  # one-deletion neighbours
            c = cell[pairs]
            keys = np.r_[keys, mix(content[c] - value[pairs] + salt[c])]
            of_key, tags = np.r_[of_key, doc[pairs]], np.r_[tags, tag[c] | ((filled[c] == 1).astype(np.int64) << 1)]
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sid[of_key]), pa.array(tags)], names=["h", "sid", "tag"])

    def run(batches):
        for b in batches:
            for g in groups(b.column("text"), lower=True):
                doc, h, n = shingle_sets(g, k)
                sid = _set_ids(doc, h, n).view(np.int64)
                own = bands.of(n)
                yield rows(doc, h, n, sid, own, True)
                yield rows(doc, h, n, sid, own - 1, False)

    return run


def _sets(k: int):
    def run(batches):
        for b in batches:
            for g in groups(b.column("text"), lower=True):
                doc, h, n = shingle_sets(g, k)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(h.view(np.int64)))
                names = [c for c in b.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(g.lo, g.hi - g.lo) for c in names), lists], names=[*names, "grams"])

    return run


def _sketches(k: int, bands: Bands):
    """Parity sketches for the set's own band and the one below: bit i tells whether an odd number of shingles hash to i.

    Two sketches differ in no more bits than the sets differ in shingles.
    """

    def rows(doc, h, n, sid, band, own):
        wide = np.where((n > 0) & (band >= 0), -(-bands.high[np.maximum(band, 0)] // 16), 0)
        base = np.r_[0, np.cumsum(wide)]
        used = wide[doc] > 0
        doc, h = doc[used], h[used]
        bit = mix(h ^ _SEG) % (wide[doc] * 64).astype(np.uint64)
        bits = np.zeros(base[-1], np.uint64)
        np.bitwise_xor.at(bits, base[doc] + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        lists = pa.ListArray.from_arrays(pa.array(base.astype(np.int32)), pa.array(bits.view(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(sid), pa.array(np.full(len(n), own)), lists], names=["sid", "own", "bits"])

    def run(batches):
        for b in batches:
            for g in groups(b.column("text"), lower=True):
                doc, h, n = shingle_sets(g, k)
                sid = _set_ids(doc, h, n).view(np.int64)
                own = bands.of(n)
                yield rows(doc, h, n, sid, own, True)
                yield rows(doc, h, n, sid, own - 1, False)

    return run


def _allocated(rows: DataFrame, bands: Bands, probe_only: bool) -> DataFrame:
    """Per set and role: its shared segments, and the units that they must still deliver (``gap`` > 0).

    ``rows`` has one row per key that the set shares with another one. Sets without a gap have no partner.
    """
    seg = F.shiftright("tag", 2).bitwiseAND(0x3FFFFFFF).cast("int")
    g = (
        rows.select("sid", F.shiftright("tag", 32).alias("n"), (F.col("tag").bitwiseAND(1) == 1).alias("own"), F.struct("h", seg.alias("seg"), (F.shiftright("tag", 1).bitwiseAND(1) == 1).alias("empty"), *(["cost"] if probe_only else [])).alias("key"))
        .groupBy("sid", "n", "own")
        .agg(F.collect_list("key").alias("keys"))
    )
    m, w, high = bands.columns(F.col("n"), F.col("own"))
    partner = F.least("n", high)
    if not probe_only:  # in its own band a set also waits for larger ones
        partner = F.when(F.col("own"), F.floor(F.col("n") * 100 / bands.t)).otherwise(partner)
    units = F.floor((F.col("n") + partner) * (100 - bands.t) / (100 + bands.t)) + 1
    hit = F.size(F.array_distinct(F.col("keys.seg")))
    return g.withColumn("w", w).withColumn("gap", units - w * (m - hit)).where("gap > 0")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, bands: Bands) -> DataFrame:
    """The pairs (a, b) of set ids whose Jaccard similarity reaches the threshold."""
    pairs = stored(pairs, "pairs")

    def sets(wanted: DataFrame, *cols: str) -> DataFrame:
        named = classes.join(wanted, classes.sid == wanted[cols[0]]).select("id", "ver", *cols)
        return docs.join(maybe_broadcast(named, 48), ["id", "ver"]).select("text", *cols).mapInArrow(_sets(k), ", ".join(f"{c} long" for c in cols) + ", grams array<long>")

    left = sets(pairs, "a", "b")
    right = sets(pairs.select("b").distinct(), "b").withColumnRenamed("grams", "other")
    both = F.size(F.array_intersect("grams", "other")).cast("long")
    total = F.size("grams") + F.size("other")
    return stored(left.join(right, "b").where(both * (100 + bands.t) >= total * bands.t).select("a", "b"), "verified")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id`` (smallest id reachable by links), ``class_id`` (set) and ``ver``.

    Words are lower-cased in A-Z only. Empty and null texts have no shingles and link with
    nothing; texts with fewer than ``k`` words have their word sequence as the only shingle. Rows with
    a null id take part, but a component's id is the smallest one that is not null (null if
    there is none; an unlinked document has its own). Rows that share an id count as separate
    documents. Other columns are ignored; an empty table gives an empty one.
    """
    bands = Bands(percent)
    docs = docs.select(F.col(id_col).alias("given"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("ver"))
    kind = docs.schema["given"].dataType.simpleString()
    measured = stored(docs.select("given", "ver", "text").mapInArrow(_measure(k), f"given {kind}, ver long, n long, sid long"), "sets")
    filled = measured.where("n > 0").withColumn("id", F.coalesce(F.col("given").cast("long"), F.lit(-(1 << 63))))
    classes = stored(filled.groupBy("sid").agg(F.min(F.struct("id", "ver")).alias("first"), F.min("given").alias("least")).select("sid", "first.*", "least"), "classes")
    copies = stored(filled.join(classes.select("sid", F.col("id").alias("i"), F.col("ver").alias("v")), "sid").where("id <> i OR ver <> v").select("id", "ver").distinct(), "copies")
    # an outer join and a filter, as Spark does not share the shuffle of an anti join below
    single = docs.join(maybe_broadcast(copies, 32).withColumn("copy", F.lit(True)), ["id", "ver"], "left").where("copy IS NULL")

    keys = single.select("text").mapInArrow(_keys(k, bands), "h long NOT NULL, sid long NOT NULL, tag long NOT NULL")
    shared = keys.alias("a").join(keys.alias("b"), F.expr("a.h = b.h AND a.sid <> b.sid AND ((a.tag | b.tag) & 1) = 1"), "left_semi")
    rows = stored(_allocated(shared, bands, False).select("sid", "n", "own", F.explode("keys").alias("key")).select("sid", "n", "own", "key.*"), "shared")

    # each class with a popular one: a text that many others derive from shares its keys with all of them
    crowd = rows.where("NOT empty").groupBy("h").agg(F.count("*").alias("c"))
    fame = rows.where("own AND NOT empty").select("sid", "h").join(crowd, "h").groupBy("sid").agg(F.sum("c").alias("fame"))
    first = rows.where("own AND NOT empty").select("sid", "h").join(fame, "sid").groupBy("h").agg(F.max_by("sid", F.struct("fame", "sid")).alias("b"), F.max("fame").alias("top"))
    star = (
        rows.where("NOT empty").select("sid", "h").join(first, "h").where("sid <> b").groupBy(F.col("sid").alias("a"), "b")
        .agg(F.count("*").alias("c"), F.max("top").alias("top")).groupBy("a").agg(F.max_by("b", F.struct("c", "top", "b")).alias("b"))
    )
    linked = _verified(star, docs, classes, k, bands)
    label = components(linked, "a", "b")

    # what different components still share
    known = rows.join(label.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    known = stored(known, "labelled")
    mixed = known.groupBy("h").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("cost")).where("x <> y").select("h", "cost")
    open_rows = known.join(mixed, "h").select("h", "sid", "cost", (F.shiftleft("n", 32) + F.shiftleft(F.col("seg").cast("long"), 2) + F.when(F.col("empty"), 2).otherwise(0) + F.col("own").cast("int")).alias("tag"))
    need = _allocated(open_rows, bands, True)
    each = need.select("sid", "n", "own", "w", "gap", F.explode("keys").alias("key")).select("sid", "n", "own", "w", "gap", "key.*")
    by_seg = each.groupBy("sid", "n", "own", "w", "gap", "seg").agg(F.sum("cost").alias("cost"), F.collect_set("h").alias("hs"))
    order = F.expr("sum(w) OVER (PARTITION BY sid, own ORDER BY cost, seg ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    contested = classes.join(open_rows.select("sid").distinct(), "sid").select("id", "ver")
    sketch = stored(docs.join(maybe_broadcast(contested, 32), ["id", "ver"]).select("text").mapInArrow(_sketches(k, bands), "sid long, own boolean, bits array<long>").dropDuplicates(["sid", "own"]), "sketches")
    probe = by_seg.withColumn("upto", order).where("upto - w < gap").select(F.col("sid").alias("r"), F.col("n").alias("rn"), "own", F.explode("hs").alias("h")).join(label.withColumnRenamed("node", "r"), "r", "left")
    probe = probe.join(sketch.toDF("r", "own", "bits"), ["r", "own"])
    target = known.where("own").join(mixed, "h").select("h", F.col("sid").alias("s"), F.col("n").alias("sn"), F.col("label").alias("sl")).join(sketch.where("own").select(F.col("sid").alias("s"), F.col("bits").alias("other")), "s")
    differ = F.aggregate(F.zip_with("bits", "other", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    near = (probe.h == target.h) & F.expr(f"r <> s AND sn <= rn AND sn * 100 >= rn * {bands.t} AND coalesce(label, r) <> sl") & (differ * (100 + bands.t) <= (F.col("rn") + F.col("sn")) * (100 - bands.t))
    pairs = probe.join(target, near).select(F.greatest("r", "s").alias("a"), F.least("r", "s").alias("b")).distinct()
    more = _verified(pairs, docs, classes, k, bands)
    label = stored(components(linked.union(more), "a", "b"), "labels")

    ends = classes.join(label.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "least", F.coalesce("label", "sid").alias("label"))
    final = ends.join(ends.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("sid", "component_id")
    out = measured.join(maybe_broadcast(stored(final, "components"), 32), "sid", "left")
    return out.select(F.col("given").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("given")).alias("component_id"), F.col("sid").alias("class_id"), "ver")
