"""Shards, fill-in-middle and whitening against brute force, on odd fixtures and on the smallest tables."""
import hashlib
import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotwise.llm import fim, queries, sharding, whitening
from slotwise.llm.common import table

SF = "/root/testdata/sf0.001"
LONG = "ß🙂a" * 700_000  # 4.9 MB
TEXTS = [None, "", " ", "a", "äö", "🙂🙃", "<P>x", "tail<", "<S", "M>" * 9, "word " * 5000, "word " * 5000, LONG, "\x00\x7f\u0080￿\U0010ffff" * 3, "plain text"]
SCHEMA = "doc_id long, text string, source string, size string, slot int, n int, form string, `a.b` int, __0 int"


def fixture(spark, copies=1):
    rows = [(i, t, [None, "", "s1", "s2"][i % 4], "x", 1, 2, "y", 3, 4) for i, t in enumerate(TEXTS * copies)]
    rows += [(None, "no id", "s1", None, None, None, None, None, None), (3, "a", "s1", None, None, None, None, None, None), (3, "a", "s1", None, None, None, None, None, 5)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def h4(doc_id):
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]


def fim_row(doc_id, text):
    t, (x, y, z, w) = text or "", h4(doc_id)
    n = len(t)
    a, b = sorted((x % (n + 1), y % (n + 1)))
    if not t or any(m in t for m in fim.MARKS) or z % 100 >= 90:
        return n, "plain", None, None, t
    p, m, s = t[:a], t[a:b], t[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if w % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle(spark):
    for d in (fixture(spark, 8), table(spark, SF, "documents")):
        rows = fim.fill_in_middle(d)
        got = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in rows.collect())
        assert got == Counter((r.doc_id, *fim_row(r.doc_id, r.text)) for r in d.select("doc_id", "text").collect())
        same = fim.digest(rows).join(d.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha")), F.col("restored_sha256") == F.col("sha"), "left_anti")
        assert same.count() == 0


def test_units_find_every_cut():
    rng = random.Random(5)
    texts = ["".join(rng.choice("aé€🙂 ") for _ in range(rng.randrange(0, 40))) for _ in range(300)]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.r_[0, np.cumsum([len(t.encode()) for t in texts])]
    u = fim.Units(raw, off)
    assert u.n.tolist() == [len(t) for t in texts]
    for _ in range(60):
        k = np.array([rng.randint(0, len(t)) for t in texts])
        assert u.bytes_of(k).tolist() == [len(t[:i].encode()) for t, i in zip(texts, k)]


def test_restore_with_torn_marks(spark):
    rows = spark.createDataFrame([("<P>a<<S><S<M>M>", "psm"), ("<S><M<P>P><<M>S>", "spm"), ("<P>", "plain")], "output string, form string")
    assert [r.t for r in rows.select(fim.restore(F.col("output"), F.col("form")).alias("t")).collect()] == ["a<M><S", "P><S><M", "<P>"]


def shard_rows(pairs, seed=11, shards=8):
    """doc_id -> (shard, slot), by sorting."""
    md5 = lambda s: hashlib.md5(f"{seed}:{s}".encode()).hexdigest()
    by = {}
    for i, s in pairs:
        by.setdefault("" if s is None else "=" + s, []).append((md5(i), i))
    order = []
    for s, rows in by.items():
        phase = (int(md5(s[1:])[:8], 16) + 0.5) / 2**32
        order += [((r + phase) / len(rows), s, r, i) for r, (_, i) in enumerate(sorted(rows))]
    out, n = {}, len(order)
    for g, (*_, i) in enumerate(sorted(order)):
        k = g * shards // n
        out[i] = (k, g - -(-k * n // shards))
    return out


@pytest.mark.parametrize("shards", [8, 3, 1])
def test_shards_match_sorting(spark, shards):
    d = table(spark, SF, "documents").withColumn("source", F.when(F.col("doc_id") % 11 == 0, None).when(F.col("doc_id") % 5 == 0, F.col("doc_id").cast("string")).otherwise(F.col("source")))
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.interleave(d, shards).collect()}
    assert got == shard_rows([(r.doc_id, r.source) for r in d.select("doc_id", "source").collect()], shards=shards)


def test_shards_of_odd_rows(spark):
    d = fixture(spark, 20)
    out = sharding.interleave(d)
    assert out.columns == ["doc_id", "text", "source", "n", "form", "a.b", "__0", "size", "text_crc32", "law", "shard", "slot"]
    rows = out.collect()
    assert Counter((r.doc_id, r.text, r["__0"]) for r in rows) == Counter((r.doc_id, r.text, r["__0"]) for r in d.collect())
    for r in rows:
        raw = (r.text or "").encode()
        assert (r["size"], r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "rows")
    slots = {k: sorted(r.slot for r in rows if r.shard == k) for k in range(8)}
    assert all(s == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    few = sharding.interleave(d.where("doc_id IN (0, 1, 2)")).collect()
    assert len({r.shard for r in few}) == 3 and {r.slot for r in few} == {0}


def test_every_shard_has_the_mixture(spark):
    """One source of a third of the rows, some middling ones and hundreds of tiny ones."""
    d = spark.range(9000).selectExpr("id AS doc_id", "'t' AS text", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN concat('m', id % 7) ELSE concat('tiny', id % 1500) END AS source")
    rows = sharding.interleave(d).groupBy("source", "shard").count().collect()
    total = Counter()
    for r in rows:
        total[r.source] += r["count"]
    for s in ["hot", *(f"m{i}" for i in range(7))]:
        counts = [next((r["count"] for r in rows if r.source == s and r.shard == k), 0) for k in range(8)]
        assert max(abs(c - total[s] / 8) for c in counts) <= 3
    tiny = [sum(r["count"] for r in rows if r.source.startswith("tiny") and r.shard == k) for k in range(8)]
    assert max(abs(c - sum(tiny) / 8) for c in tiny) <= 3


def test_shard_files_hold_slots_in_order(spark, tmp_path):
    d = table(spark, SF, "documents")
    out = sharding.interleave(d, 4)
    sharding.write_shards(out, str(tmp_path / "s"), rows_per_file=20)
    back = spark.read.parquet(str(tmp_path / "s")).withColumn("file", F.input_file_name())
    assert {(r.doc_id, r.shard, r.slot) for r in back.collect()} == {(r.doc_id, r.shard, r.slot) for r in out.collect()}
    sizes = back.groupBy("file").agg(F.count("*").alias("n"), (F.max("slot") - F.min("slot")).alias("span")).collect()
    assert all(r.n <= 20 and r.span == r.n - 1 for r in sizes) and len(sizes) >= 10


def white_rows(vectors, counted=False):
    """[(id, component, n, deviation, |whitened|, explained)] by plain numpy on exact sums, and the covariance."""
    ok = [(i, tuple(math.floor(256 * c) for c in v)) for i, v in vectors if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    fit = Counter(x for _, x in ok)
    w = [c if counted else 1 for c in fit.values()]
    n, d = sum(w), len(ok[0][1])
    s = [sum(k * x[j] for x, k in zip(fit, w)) for j in range(d)]
    centred = np.array([[float(Fraction(n * v - t, n)) for v, t in zip(x, s)] for x in fit])
    cov = (centred * np.array(w)[:, None]).T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:4], u[:, ::-1][:, :4]
    place = {x: (centred[k] @ u) / np.sqrt(e) for k, x in enumerate(fit)}
    return [(i, c + 1, n, sum((n * v - t) ** 2 for v, t in zip(x, s)), abs(place[x][c]), e[c] / np.trace(cov)) for i, x in ok for c in range(len(e))]


def same_rows(got, want):
    key = lambda r: (str(r[0]), r[1], r[3])
    got = sorted(((r[0], r.component, r.n, int(r.deviation), abs(r.whitened), r.explained) for r in got), key=key)
    want = sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose([r[4:] for r in got], [r[4:] for r in want], rtol=1e-7, atol=1e-9)


@pytest.mark.parametrize("weights", ["one", "count"])
def test_whitening(spark, weights):
    rng = np.random.default_rng(2)
    base = rng.normal(0.3, 1, (400, 6)) * np.array([3, 2, 1, 0.5, 0.25, 0.1])
    rows = [(i, [float(c) for c in v], i) for i, v in enumerate(np.vstack([base, base[:50], np.repeat(base[:1], 300, 0)]))]
    bad = [(2000, None, 0), (2001, [float("nan")] * 6, 0), (2002, [None] * 6, 0), (2003, [1.0] * 5 + [float("inf")], 0), (2004, [], 0), (None, [-0.0] * 6, 0), (5, [1e-9] * 6, 0)]
    d = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, n int").repartition(7)
    got = whitening.whiten(d, weights=weights).collect()
    same_rows(got, white_rows([r[:2] for r in rows + bad], weights == "count"))
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_whitening_of_the_table(spark):
    d = table(spark, SF, "embeddings")
    got = queries.QUERIES["op13_whitening"](spark, SF).collect()
    same_rows(got, white_rows([(r.vec_id, r.embedding) for r in d.collect()]))


def test_whitening_without_variance_and_of_several_lengths(spark):
    rows = [(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0]), (3, [0.5, 0.25]), (4, [1.5, -3.0]), (5, [2.0, 1.0]), (6, [7.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert Counter(r.vec_id for r in got) == {1: 3, 2: 3, 3: 2, 4: 2, 5: 2, 6: 1}
    for r in got:
        if r.vec_id in (3, 4, 5):
            assert r.n == 3 and math.isfinite(r.whitened) and r.identity_error < 1e-12
        else:
            assert (r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, None, None, None)


def test_deviation_beyond_64_bits_is_exact(spark):
    big = 2.0**45
    rows = [(i, [big * i, -big, 1.0 + i]) for i in range(50)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), scale=1)
    n, s = 50, [sum(int(r[1][k]) for r in rows) for k in range(3)]
    want = {i: sum((n * int(v) - t) ** 2 for v, t in zip(x, s)) for i, x in rows}
    assert {r.vec_id: int(r.deviation) for r in got.collect()} == want and max(want.values()) > 1 << 63


def test_empty_tables_give_no_rows(spark):
    none = fixture(spark).limit(0)
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert [x.count() for x in (fim.digest(fim.fill_in_middle(none)), sharding.interleave(none), whitening.digest(whitening.whiten(vectors)))] == [0, 0, 0]
