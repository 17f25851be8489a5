"""Personal data by weak supervision, in DataFrame functions only.

Four base kinds (email, ip, card, phone) are exact patterns with a check; their spans always stay. Further
candidates are long tokens that mix letters and digits. Labelers vote on every candidate: its pattern
and check, a gazetteer of prefixes and endings, trigger words before it, and the variety of its
characters. Votes are counted by pattern over all documents (a bounded table); expectation-maximisation
estimates each labeler's reliability from the counts, and a logistic span classifier is fitted
to the posteriors. Candidates that it accepts are added as kind ``secret``.

Patterns are written with possessive repeats and start only where a run starts, which finds the same
leftmost matches in linear time and without deep recursion.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
_P = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?:\G|(?<![A-Za-z0-9_/+=-]))(?=[A-Za-z_/+=-]*+[0-9])(?=[0-9_/+=-]*+[A-Za-z])[A-Za-z0-9_/+=-]{16,}+",
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
# Words and endings that the labelers know.
_PREFIXES = r"^(?:AKIA|ASIA|ghp_|gho_|sk-|xox[bp]-|AIza|(?:api_?key|key|password|passwd|pwd|secret|token)[=:])"
_ENDINGS = r"\.(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|ch|at)$"
_TRIGGERS = r"(?:mail|contact|call|phone|tel|fax|card|visa|ip|host|server|key|token|secret|password|login|auth)\W*$"
LABELERS = 4
_VOTES = [f"v{i}" for i in range(LABELERS)] + ["size"]


def _sums(values: Column) -> Column:
    """Running sums of an int array, in blocks of 64 so that long arrays stay cheap."""
    grow = lambda s, y: F.struct((s.at + y).alias("at"), F.concat(s.out, F.array(s.at + y)).alias("out"))
    start = lambda at: F.struct(at.alias("at"), F.array().cast("array<int>").alias("out"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / 64).cast("int")), lambda b: F.slice(values, b * 64 + 1, 64))
    totals = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda s, y: s + y))
    ends = F.aggregate(totals, start(F.lit(0)), grow).out
    inner = F.zip_with(blocks, F.zip_with(ends, totals, lambda e, t: e - t), lambda x, o: F.aggregate(x, start(o), grow).out)
    return F.when(F.size(values) > 0, F.flatten(inner)).otherwise(F.array().cast("array<int>"))


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.when(i % 2 == 1, F.substr(back, i, F.lit(1)).cast("int")).otherwise(F.substr(back, i, F.lit(1)).cast("int") * 2))
    return F.aggregate(each, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _checked(kind: str, v: Column) -> Column:
    digits = F.regexp_replace(v, "[^0-9]", "")
    if kind == "ip":
        return v.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "secret":
        return v.rlike(r"^(?:AKIA[0-9A-Z]{16}|[0-9a-f]{32,}|[A-Za-z_]+=[0-9A-Za-z]{12,})$")
    return F.lit(True)


def candidates(docs: DataFrame, text: str) -> DataFrame:
    """Adds ``c_<kind>``: arrays of (kind, start, end, ok, v0..v3, size) for the matches in column ``text``."""
    gate = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    for k, p in _P.items():
        on = F.col(text).isNotNull() & gate.get(k, F.lit(True))
        docs = docs.withColumn(f"m_{k}", F.when(on, F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>")))
        docs = docs.withColumn(f"g_{k}", F.when(F.size(f"m_{k}") > 0, F.split(text, p, -1)).otherwise(F.array().cast("array<string>")))
        docs = docs.withColumn(f"e_{k}", _sums(F.zip_with(F.slice(f"g_{k}", 1, F.size(f"m_{k}")), f"m_{k}", lambda g, m: F.length(g) + F.length(m))))
        docs = docs.withColumn(f"c_{k}", _ballots(k)).drop(f"m_{k}", f"g_{k}", f"e_{k}")
    return docs


def _ballots(kind: str) -> Column:
    return F.transform(f"m_{kind}", lambda m, i: _votes(kind, m, F.get(f"g_{kind}", i), F.get(f"e_{kind}", i)))


def _votes(kind: str, m: Column, gap: Column, end: Column) -> Column:
    known = {"email": F.lower(m).rlike(_ENDINGS), "ip": ~m.rlike(r"^(?:0|127|255)\."), "card": m.rlike("^[3-6]"), "phone": F.lit(True), "secret": m.rlike(_PREFIXES)}[kind]
    context = F.lower(F.right(gap, F.lit(24))).rlike(_TRIGGERS)
    variety = F.size(F.array_distinct(F.split(F.left(m, F.lit(64)), ""))) >= {"email": 5, "ip": 4, "card": 4, "phone": 5, "secret": 9}[kind]
    ok = _checked(kind, m)
    yes = lambda c: c.cast("int")
    size = F.least(F.floor(F.length(m) / 8), F.lit(7)).cast("int")
    return F.struct(F.lit(kind).alias("kind"), (end - F.length(m)).alias("start"), end.alias("end"), ok.alias("ok"), yes(ok).alias("v0"), yes(known).alias("v1"), F.when(context, 1).otherwise(-1).alias("v2"), yes(variety).alias("v3"), size.alias("size"))


def fit(docs: DataFrame, text_col: str = "text") -> dict[tuple, float]:
    """Weights of the span classifier: (kind, column, value) -> log-odds, and (kind, "", 0) the intercepts.

    Only counts of vote patterns reach the driver: at most 5 kinds x 3**4 votes x 8 sizes.
    """
    c = candidates(docs.select(F.col(text_col).alias("text")), "text")
    rows = c.select(F.explode(F.concat(*[F.col(f"c_{k}") for k in _P])).alias("c")).groupBy("c.kind", *[f"c.{v}" for v in _VOTES]).count().collect()
    weights: dict[tuple, float] = {}
    for kind in _P:
        own = [r for r in rows if r.kind == kind]
        if not own:
            continue
        votes, n = np.array([[r[v] for v in _VOTES[:-1]] for r in own]), np.array([r["count"] for r in own], float)
        cast = votes >= 0
        post = ((votes * cast).sum(1) + 0.5) / (cast.sum(1) + 1)  # start: share of yes
        for _ in range(50):
            prior = np.clip((n * post).sum() / n.sum(), 1e-3, 1 - 1e-3)
            hit = ((n * post)[:, None] * votes * cast).sum(0) + 1
            hit /= ((n * post)[:, None] * cast).sum(0) + 2
            false = ((n * (1 - post))[:, None] * votes * cast).sum(0) + 0.5
            false /= ((n * (1 - post))[:, None] * cast).sum(0) + 2
            odds = np.log(prior / (1 - prior)) + (cast * np.where(votes == 1, np.log(hit / false), np.log((1 - hit) / (1 - false)))).sum(1)
            post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        names = sorted({(v, r[v]) for r in own for v in _VOTES})
        x = np.array([[1.0] + [float(r[v] == y) for v, y in names] for r in own])
        w = np.zeros(x.shape[1])
        for _ in range(30):  # ridge-regularised Newton steps
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (n * (p - post)) + w
            w -= np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w)), grad)
        weights[(kind, "", 0)] = float(w[0])
        weights |= {(kind, v, y): float(a) for (v, y), a in zip(names, w[1:])}
    return weights


def _accepted(c: Column, kind: str, weights: dict[tuple, float]) -> Column:
    total = F.lit(weights.get((kind, "", 0), -1.0))
    for (k, v, y), a in weights.items():
        if k == kind and v:
            total = total + F.when(c[v] == y, a).otherwise(0.0)
    return total > 0


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``base`` and ``spans``, arrays of (kind, start, end) by kind, then start.

    Positions are code points, ends exclusive. Null and empty texts have no spans. Null and
    repeated ids are kept, each row for itself. Other columns are ignored; an empty table gives an empty one.
    """
    return _spans(docs.select(F.col(id_col).alias("given"), F.col(text_col).alias("text")), fit(docs, text_col)).select(F.col("given").alias(id_col), "base", "spans")


def _spans(rows: DataFrame, weights: dict[tuple, float]) -> DataFrame:
    out = candidates(rows, "text")
    span = lambda c: F.struct(c.kind, c.start, c.end)
    base = F.concat(*[F.transform(F.filter(f"c_{k}", lambda c: c.ok), span) for k in KINDS])
    added = F.transform(F.filter("c_secret", lambda c: _accepted(c, "secret", weights)), span)
    return out.withColumn("base", base).withColumn("spans", F.concat("base", added)).drop(*[f"c_{k}" for k in _P])


def digest(result: DataFrame, id_col: str = "doc_id") -> DataFrame:
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    return result.select(id_col, *[count(k) for k in KINDS], F.sha2(text("base").cast("binary"), 256).alias("base_sha256"), text("spans").alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans by that of the first. ``size_col`` follows."""
    wide = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"))
    found = _spans(wide, fit(docs, text_col)).withColumn("s", F.array_sort(F.transform("spans", lambda s: F.struct(s.start, s.end, s.kind))))
    # disjoint spans, then the pieces around them
    merged = F.aggregate("s", F.array().cast("array<struct<start:int,end:int,kind:string>>"), lambda a, s: F.when(
        (F.size(a) > 0) & (s.start < F.get(a, F.size(a) - 1).end),
        F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.get(a, F.size(a) - 1).start.alias("start"), F.greatest(F.get(a, F.size(a) - 1).end, s.end).alias("end"), F.get(a, F.size(a) - 1).kind.alias("kind")))),
    ).otherwise(F.concat(a, F.array(F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind"))))))
    found = found.withColumn("s", merged)
    before = lambda i: F.when(i == 0, 0).otherwise(F.get("s", i - 1).end)
    parts = F.transform("s", lambda s, i: F.concat(F.substr("text", before(i) + 1, s.start - before(i)), F.lit("["), F.upper(s.kind), F.lit("]")))
    tail = F.substr("text", F.get("s", F.size("s") - 1).end + 1)
    new = F.when(F.size("s") > 0, F.concat(F.array_join(parts, ""), tail)).otherwise(F.col("text"))
    out = found.select("row", new.alias("__new"))
    return out.select(*[F.col("__new").alias(c) if c == text_col else F.length("__new").cast(docs.schema[c].dataType).alias(c) if c == size_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
