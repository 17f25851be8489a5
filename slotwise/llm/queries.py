"""Registered queries of the operators, each over its whole table, with the SQL that checks it where SQL can say it."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.llm import decontam, fim, jaccard, licenses, lm, neighbours, packing, pii, quality, sharding, substring, toxicity, whitening
from slotwise.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


@query(
    "op10_substring_dedup",
    r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    win AS (
        SELECT doc_id, p, array_to_string(w[p + 1:p + 20], ' ') AS seq
        FROM (SELECT doc_id, w, unnest(range(0, len(w) - 19)) AS p FROM d)
    ),
    ranked AS (SELECT doc_id, p, row_number() OVER (PARTITION BY seq ORDER BY doc_id, p) AS k FROM win),
    gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS p FROM ranked WHERE k > 1),
    word AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM d),
    left_over AS (
        SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n
        FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
    )
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM d LEFT JOIN left_over USING (doc_id)
    """,
)
def op10(spark, sf_dir):
    return substring.digest(substring.dedup_substrings(table(spark, sf_dir, "documents")))


@query(
    "op5_jaccard_join",
    r"""
    WITH RECURSIVE d AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
        FROM documents
    ),
    sh AS (
        SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s
        FROM d
    ),
    one AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sh),
    pair AS (
        SELECT a.doc_id AS x, b.doc_id AS y
        FROM one a JOIN one b ON a.g = b.g AND a.doc_id <> b.doc_id
        GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
    ),
    reach AS (
        SELECT doc_id AS x, doc_id AS y FROM d
        UNION
        SELECT reach.x, pair.y FROM reach JOIN pair ON reach.y = pair.x
    )
    SELECT sh.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, CAST(m AS BIGINT) AS component_id
    FROM sh JOIN (SELECT x AS doc_id, min(y) AS m FROM reach GROUP BY x) USING (doc_id)
    """,
)
def op5(spark, sf_dir):
    return jaccard.jaccard_components(table(spark, sf_dir, "documents")).drop("class_id", "ver")


@query("op1_packing")
def op1(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), digests=True)


@query("op3_quality_neighbours")
def op3(spark, sf_dir):
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_toxicity_ftrl")
def op6(spark, sf_dir):
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    "op4_decontaminate",
    r"""
    WITH d AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM documents
    ),
    b AS (
        SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM benchmark
    ),
    item AS (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
    win AS (SELECT DISTINCT item_id, n, array_to_string(w[p + 1:p + n], ' ') AS seq FROM (SELECT *, unnest(range(0, len(w) - n + 1)) AS p FROM item)),
    spot AS (
        SELECT doc_id, n, p, array_to_string(w[p + 1:p + n], ' ') AS seq
        FROM (SELECT doc_id, w, n, unnest(range(0, greatest(len(w) - n + 1, 0))) AS p FROM d, (SELECT DISTINCT n FROM item))
    ),
    hit AS (SELECT doc_id, item_id, n, p FROM spot JOIN win USING (n, seq)),
    cover AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
    names AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
        sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN names USING (doc_id)
    """,
)
def op4(spark, sf_dir):
    return decontam.digest(decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@query("op2_personal_data")
def op2(spark, sf_dir):
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


@query("op9_lm_bloom")
def op9(spark, sf_dir):
    return lm.score(table(spark, sf_dir, "documents"))


@query("op7_nn_descent")
def op7(spark, sf_dir):
    return neighbours.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op8_license_scan")
def op8(spark, sf_dir):
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


#: crc32 by bytes, from the right-shifting table of polynomial 0xEDB88320.
_CRC32 = """
    poly AS (
        SELECT list(v ORDER BY b) AS tab
        FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) AS t(b))
    ),
    crc AS (
        SELECT doc_id, t, xor(list_reduce(list_prepend(4294967295, [CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT) FOR i IN range(0, len(x) // 2)]),
            lambda c, b: xor(c // 256, tab[xor(c, b) % 256 + 1])), 4294967295) AS text_crc32
        FROM (SELECT doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS x FROM documents), poly
    )"""


@query(
    "op11_shard_mixture",
    f"""
    WITH {_CRC32.strip()},
    d AS (SELECT doc_id, coalesce('=' || source, '') AS s, md5('11:' || doc_id) AS h FROM documents),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY s ORDER BY h) - 1 AS r, count(*) OVER (PARTITION BY s) AS n,
            (CAST('0x' || md5('11:' || s[2:])[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE AS phase
        FROM d
    ),
    sorted AS (SELECT doc_id, row_number() OVER (ORDER BY (r + phase) / n, s, r) - 1 AS g, count(*) OVER () AS total FROM ranked),
    cut AS (SELECT doc_id, g, total, g * 8 // total AS shard FROM sorted)
    SELECT doc_id, CAST(octet_length(encode(t)) + 1 AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(shard AS INT) AS shard,
        CAST(g - (shard * total + 7) // 8 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard
    FROM cut JOIN crc USING (doc_id)
    """,
)
def op11(spark, sf_dir):
    placed = sharding.interleave(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), columns=["doc_id"])
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query(
    "op12_fill_in_middle",
    """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS x FROM documents),
    h AS (SELECT *, CAST('0x' || x[1:8] AS BIGINT) % (n + 1) AS p, CAST('0x' || x[9:16] AS BIGINT) % (n + 1) AS q, CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
    c AS (
        SELECT doc_id, t, n, least(p, q) AS a, greatest(p, q) AS b,
            CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
        FROM h
    ),
    o AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM c)
    SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(CASE WHEN form <> 'plain' THEN a END AS BIGINT) AS prefix_chars, CAST(CASE WHEN form <> 'plain' THEN b - a END AS BIGINT) AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
        sha256(t) AS restored_sha256
    FROM o
    """,
)
def op12(spark, sf_dir):
    return fim.digest(fim.fill_in_middle(table(spark, sf_dir, "documents")))


@query("op13_whitening")
def op13(spark, sf_dir):
    return whitening.digest(whitening.whiten(table(spark, sf_dir, "embeddings")))
