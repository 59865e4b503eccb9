"""Registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .sentencepiece_wfst import encode

    return encode(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pii

    return pii(_read(spark, sf_dir, "documents"), key="docfacts")


def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import labelled_pages, url_filter

    pages = _read(spark, sf_dir, "pages")
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    return url_filter(spark, pages, labelled_pages(pages, _read(spark, sf_dir, "labels")), rules)


def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embed_dedup import embedding_near_duplicates

    return embedding_near_duplicates(spark, _read(spark, sf_dir, "embeddings"))


def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(spark, _read(spark, sf_dir, "documents"), k=2)


def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .vptree import nearest

    return nearest(spark, _read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import warc_round_trip

    return warc_round_trip(spark, _read(spark, sf_dir, "pages"))


def _op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import resample

    return resample(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), buckets=10_000, runs=1, percent=10, least_words=20, seed="2024")


def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .alignment import align

    return align(spark, _read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def _op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe_automaton import round_trip

    return round_trip(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Query] = {
    "op1_sentencepiece": _op1,
    "op2_pii": _op2,
    "op3_url_filter": _op3,
    "op4_toxicity": _op4,
    "op5_packing": _op5,
    "op6_embedding_near_dedup": _op6,
    "op7_minhash_near_dedup": _op7,
    "op8_nearest_neighbours": _op8,
    "op9_quality": _op9,
    "op10_warc": _op10,
    "op11_importance": _op11,
    "op12_alignment": _op12,
    "op13_bpe_automaton": _op13,
}

# Each states the operator's result by brute force; the Spark plans reach it by other means.
ORACLE_SQL: dict[str, str] = {
    "op6_embedding_near_dedup": r"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a, min(b) AS m FROM reach GROUP BY 1), n AS (SELECT a, count(*) AS k FROM links GROUP BY 1)
SELECT vec_id, coalesce(n.k, 0) AS n_links, least(vec_id, coalesce(c.m, vec_id)) AS component_id, vec_id <= coalesce(c.m, vec_id) AS kept FROM embeddings e LEFT JOIN n ON e.vec_id = n.a LEFT JOIN c ON e.vec_id = c.a
""",
    "op7_minhash_near_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s FROM w),
k AS (SELECT doc_id, len(s) AS n, md5(array_to_string(list_sort(s), chr(10))) AS h, s FROM s WHERE len(s) > 0),
r AS (SELECT h, min(doc_id) AS id, any_value(n) AS n, any_value(s) AS s FROM k GROUP BY h),
u AS (SELECT id, n, unnest(s) AS x FROM r), f AS (SELECT x, count(*) AS c FROM u GROUP BY 1 HAVING count(*) > 1),
o AS (SELECT u.id, u.n, u.x, row_number() OVER (PARTITION BY u.id ORDER BY coalesce(f.c, 1), u.x) AS pos FROM u LEFT JOIN f ON u.x = f.x),
p AS (SELECT id, n, x FROM o WHERE pos <= n - ceil(0.8 * n) + 1),
cand AS (SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b ON a.x = b.x AND a.id < b.id AND a.n >= 0.8 * b.n AND b.n >= 0.8 * a.n),
links AS (SELECT a, b FROM cand JOIN r x ON x.id = a JOIN r y ON y.id = b WHERE 100 * len(list_intersect(x.s, y.s)) >= 80 * (x.n + y.n - len(list_intersect(x.s, y.s)))),
sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM sym UNION SELECT r.a, l.b FROM reach r JOIN sym l ON r.b = l.a),
c AS (SELECT a, min(b) AS m FROM reach GROUP BY 1)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(least(r.id, c.m), s.doc_id) AS component_id, s.doc_id = coalesce(least(r.id, c.m), s.doc_id) AS kept FROM s LEFT JOIN k ON s.doc_id = k.doc_id LEFT JOIN r ON k.h = r.h LEFT JOIN c ON c.a = r.id
""",
    "op10_warc": r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages), h AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS x FROM p),
d AS (SELECT page_id, n, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(x, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31), 1)), 'string_agg', '') AS digest FROM h),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f
""",
    "op11_importance": r"""
WITH t AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS x FROM benchmark),
f AS (SELECT doc_id, unnest(w) AS x FROM w),
v AS (SELECT x, xor(list_reduce(list_transform(range(0, octet_length(encode(x))), lambda i: CAST('0x' || substr(hex(encode(x)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)), lambda c, y: xor(c >> 8, t[CAST(1 + (xor(c, y) & 255) AS BIGINT)]), 4294967295), 4294967295) % 10000 AS k
  FROM (SELECT DISTINCT x FROM (SELECT x FROM f UNION ALL SELECT x FROM b)), t),
s AS (SELECT k, count(*) AS s FROM f JOIN v USING (x) GROUP BY 1), u AS (SELECT k, count(*) AS t FROM b JOIN v USING (x) GROUP BY 1),
g AS (SELECT k, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * ((SELECT count(*) FROM f) + 10000) AS DOUBLE) / CAST((coalesce(s, 0) + 1) * ((SELECT count(*) FROM b) + 10000) AS DOUBLE))) AS BIGINT) AS g
  FROM (SELECT DISTINCT k FROM v) LEFT JOIN s USING (k) LEFT JOIN u USING (k)),
m AS (SELECT doc_id, CAST(floor(sum(g) / count(*)) AS BIGINT) AS weight FROM f JOIN v USING (x) JOIN g USING (k) GROUP BY 1),
d AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM w LEFT JOIN m USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM d)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= 10 * n // 100 THEN r END AS rank FROM r
""",
}
