"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs of the training documents are quantised to levels, two an octave (1, 2, 3, 4, 6, 8, 12,
...), and an n-gram of level q is stored q times, as (n-gram, 1) to (n-gram, q). Probing the levels upwards until one
is missing gives back the level. The filter has ``BITS_PER_TOKEN`` bits per training token up to ``MAX_BITS`` (so its size
is bounded; beyond that only its error rate grows, no n-gram is dropped) and goes to every scoring task.

A word after another one has the probability (pair + MASS one) / (predecessor + MASS): ``one`` is the word's add-one
probability, in which all unknown words share one place; ``pair`` and ``predecessor`` are counts. A level stands for
its smallest count in ``pair`` and ``one`` and for its largest in ``predecessor``, where frequent words have their true
counts. So the probabilities after any word sum to one at most, and to one where levels are exact; only false
positives of the filter add to that.

The exact unigram score needs true counts: the most frequent words (at most ``HOT``) go to every task, tokens
of all others are joined with the vocabulary.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import fold, stored
from slotwise.llm.words import Group, groups, mix

BITS_PER_TOKEN, MAX_BITS, PROBES, BLOCKS, HOT, MASS = 4, 1 << 29, 2, 1024, 1 << 18, 16.0
#: N-grams that a task counts at a time.
GRAMS = 1 << 20
#: Smallest count of each level, and one past the last.
EDGES = np.unique(np.array([2.0**k * x for k in range(62) for x in (1, 1.5) if 2.0**k * x >= 1 and (2.0**k * x) % 1 == 0]))
_END, _START, _STEP = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F), np.uint64(0x9E3779B97F4A7C15)


def _tokens(g: Group) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, hash and predecessor's hash of each token; every document ends with the end token."""
    n = np.diff(g.first) + 1
    ends = np.cumsum(n) - 1
    token = np.full(int(n.sum()), _END)
    word = np.ones(len(token), bool)
    word[ends] = False
    token[word] = g.hashes
    before = np.r_[_START, token[:-1]]
    before[np.r_[0, ends[:-1] + 1]] = _START
    return np.repeat(np.arange(len(n)), n), token, before


def _pair(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(31) + token)


def _counts(pairs: bool):
    """Counts of the n-grams of some documents at a time; ``GRAMS`` bounds the working arrays."""

    def counted(seen):
        h, c = np.unique(np.concatenate(seen), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["g", "c"])

    def run(batches):
        seen, size = [], 0
        for b in batches:
            for g in groups(b.column("text"), lower=True):
                _, token, before = _tokens(g)
                seen += [_pair(before, token), token] if pairs else [token]
                size += len(token) * (1 + pairs)
                if size >= GRAMS:
                    yield counted(seen)
                    seen, size = [], 0
        if seen:
            yield counted(seen)

    return run


def _cells(h: np.ndarray, level: int, bits: int) -> list[np.ndarray]:
    """Bit positions, inside the n-gram's block, of one level."""
    x = mix(h + np.uint64(int(_STEP) * level % (1 << 64)))
    return [((x >> np.uint64(32 * k)) & np.uint64(0xFFFFFFFF)) % np.uint64(bits) for k in range(PROBES)]


def _blocks(bits: int):
    """Filter blocks from (g, c) rows sorted by g; counts of one g are added across rows and batches."""

    def run(batches):
        block, data, held = None, None, None

        def put(h, c):
            q = np.searchsorted(EDGES, c, "right")
            for level in range(1, int(q.max()) + 1):
                h, q = h[q >= level], q[q >= level]
                for cell in _cells(h, level, bits):
                    np.bitwise_or.at(data, (cell >> np.uint64(3)).astype(np.int64), np.uint8(1) << (cell & np.uint64(7)).astype(np.uint8))

        def done():
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([data.tobytes()])], names=["block", "bits"])

        def spread(h, c):
            nonlocal block, data
            part = (h >> np.uint64(54)).astype(int)
            cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            for a, e in zip(cut, np.r_[cut[1:], len(h)]):
                if part[a] != block:
                    if block is not None:
                        yield done()
                    block, data = int(part[a]), np.zeros(-(-bits // 8), np.uint8)
                put(h[a:e], c[a:e])

        for b in batches:
            h, c = b.column("g").to_numpy().view(np.uint64), b.column("c").to_numpy()
            if not len(h):
                continue
            if held:
                h, c = np.r_[held[0], h], np.r_[held[1], c]
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            h, c = h[first], np.add.reduceat(c, first)
            held = (h[-1:], c[-1:])
            if len(h) > 1:
                yield from spread(h[:-1], c[:-1])
        if held:
            yield from spread(*held)
            yield done()

    return run


def _levels(h: np.ndarray, filters: np.ndarray, bits: int) -> np.ndarray:
    """Levels of n-grams, 0 where the first one is missing."""
    level, live = np.zeros(len(h), np.int64), np.arange(len(h))
    base = (h >> np.uint64(54)).astype(np.int64) * filters.shape[1]
    flat = filters.ravel()
    step = 1
    while len(live) and step < len(EDGES):
        ok = np.ones(len(live), bool)
        for cell in _cells(h[live], step, bits):
            ok &= (flat[base[live] + (cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 > 0
        live = live[ok]
        level[live] = step
        step += 1
    return level


_LEAST, _MOST = np.r_[0.0, EDGES], np.r_[0.0, EDGES[1:] - 1, EDGES[-1]]


def probability(pair: np.ndarray, word: np.ndarray, predecessor: np.ndarray, total: int, kinds: int) -> np.ndarray:
    """Of a word after another, from the counts of both together, of the word and of its predecessor."""
    return (pair + MASS * (word + 1) / (total + kinds + 1)) / (predecessor + MASS)


def _score(model, hot, bits: int, total: int, kinds: int, floor: int):
    def run(batches):
        filters, (hot_h, hot_c) = model.value, hot.value
        low = float(total + kinds + 1)
        for b in batches:
            for g in groups(b.column("text"), lower=True):
                doc, token, before = _tokens(g)
                n = g.hi - g.lo
                at = np.searchsorted(hot_h, token)
                at[at == len(hot_h)] = 0
                known = hot_h[at] == token if len(hot_h) else np.zeros(len(token), bool)
                c = hot_c[at] if len(hot_h) else np.zeros(len(token))
                both, alone = _levels(_pair(before, token), filters, bits), np.zeros(len(token), np.int64)
                alone[~known] = _levels(token[~known], filters, bits)
                # a predecessor is the token before
                left = np.where(before == _START, float(floor), np.r_[0.0, np.where(known, c, _MOST[alone])[:-1]])
                p = probability(_LEAST[both], np.where(known, c, _LEAST[alone]), left, total, kinds)
                base = np.bincount(doc[known], weights=np.log10((c[known] + 1) / low), minlength=n)
                rare_doc, rare = doc[~known], token[~known]
                order = np.lexsort((rare, rare_doc))
                rare_doc, rare = rare_doc[order], rare[order]
                first = np.flatnonzero(np.r_[True, (rare[1:] != rare[:-1]) | (rare_doc[1:] != rare_doc[:-1])]) if len(rare) else np.zeros(0, np.int64)
                times = np.diff(np.r_[first, len(rare)])
                cut = pa.array(np.searchsorted(rare_doc[first], np.arange(n + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(b.column(x).slice(g.lo, n) for x in ("given", "uid")), pa.array(np.bincount(doc, minlength=n).astype(np.int64)), pa.array(np.bincount(doc[known], minlength=n).astype(np.int64)), pa.array(base),
                        pa.array(np.bincount(doc, weights=np.log10(p), minlength=n)), pa.ListArray.from_arrays(cut, pa.array(rare[first].view(np.int64))), pa.ListArray.from_arrays(cut, pa.array(times.astype(np.int64))),
                    ],
                    names=["given", "uid", "n_tokens", "known", "base", "score", "rare", "times"],
                )

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, out_fold: int = 2) -> DataFrame:
    """One row per document: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Words are lower-cased in A-Z; one end token follows. Null and empty texts are the end token alone.
    A null id is not held out; repeated rows count each. Other columns are ignored. Without
    training documents every count is 0. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    out = F.coalesce(fold(F.col(id_col), folds) == out_fold, F.lit(False))
    rows = docs.select(F.col(id_col).alias("given"), F.col(text_col).alias("text"), out.alias("out"))
    train = rows.where("NOT out").select("text")
    words = stored(train.mapInArrow(_counts(False), "g long, c long").groupBy("g").agg(F.sum("c").alias("c")).withColumn("level", F.floor(8 * F.log2("c")).cast("int")), "vocabulary")
    total, kinds, ends = words.agg(F.sum("c"), F.count("*"), F.max(F.when(F.col("g") == int(_END.view(np.int64)), F.col("c")))).first()
    total, ends = total or 0, ends or 0
    bits = max(64, -(-min(MAX_BITS, BITS_PER_TOKEN * total) // BLOCKS))
    grams = train.mapInArrow(_counts(True), "g long, c long").repartition(F.shiftrightunsigned("g", 54)).sortWithinPartitions("g")
    filters = np.zeros((BLOCKS, -(-bits // 8)), np.uint8)
    made = stored(grams.mapInArrow(_blocks(bits), "block int, bits binary"), "filter")
    for a in range(0, BLOCKS, BLOCKS // 8):  # BLOCKS rows, MAX_BITS in all
        for r in made.where(F.col("block").between(a, a + BLOCKS // 8 - 1)).collect():
            filters[r.block] |= np.frombuffer(r.bits, np.uint8)
    level, room = 8 * 64, HOT
    for r in words.groupBy("level").count().orderBy(F.desc("level")).collect():
        if r["count"] > room:
            break
        level, room = r.level, room - r["count"]
    hot = sorted((r.g % (1 << 64), r.c) for r in words.where(F.col("level") >= level).select("g", "c").collect())
    hot = (np.array([x for x, _ in hot], np.uint64), np.array([c for _, c in hot], float))
    sc = spark.sparkContext
    kind = docs.schema[id_col].dataType.simpleString()
    shipped = [sc.broadcast(filters), sc.broadcast(hot)]
    run = _score(*shipped, bits, total, kinds, ends)
    each = stored(rows.withColumn("uid", F.monotonically_increasing_id()).select("given", "uid", "text").mapInArrow(run, f"given {kind}, uid long, n_tokens long, known long, base double, score double, rare array<long>, times array<long>"), "scored")
    for b in shipped:  # the scores are written, no task asks for the filter again
        b.destroy()
    rest = each.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("uid", F.col("x.rare").alias("g"), "x.times").join(words.where(F.col("level") < level).select("g", "c"), "g", "left")
    rest = rest.groupBy("uid").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known_too"), F.sum(F.col("times") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(total + kinds + 1)))).alias("base_too"))
    return each.join(rest, "uid", "left").select(
        F.col("given").alias(id_col), F.coalesce(fold(F.col("given"), folds) == out_fold, F.lit(False)).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("known_too", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("base_too", F.lit(0.0))).alias("base_score"), "score",
    )
