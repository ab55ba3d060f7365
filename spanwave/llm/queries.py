"""Registered queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwave import session
from spanwave.llm import bpe, clustering, decontaminate, jaccard_join, language_id, line_dedup, near_dup, personal_data, quality, secret_scan, sharding, source_audit, suffix_dedup

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return session.prepare(spark).read.parquet(f"{folder}/{name}.parquet")


@query
def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, folder, "documents"))
    return done.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


LINES = r"""
lines AS (
  SELECT doc_id, line, i,
    translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
)
"""

ORACLES["op1_line_dedup"] = f"""
WITH {LINES},
seen AS (
  SELECT k, max(doc_id) AS last FROM lines WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE doc_id < last) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE last IS NULL OR doc_id >= last), '')) AS kept_sha256
FROM lines LEFT JOIN seen USING (k) GROUP BY doc_id
"""


@query
def op9_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    documents = table(spark, folder, "documents").select("doc_id", "text")
    vocabulary = bpe.load(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.digests(bpe.decode(bpe.encode(documents, vocabulary).select("doc_id", "ids"), vocabulary))


@query
def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    done = language_id.identify(table(spark, folder, "documents").select("doc_id", "text", "lang", "source"))
    return done.select("doc_id", "language", F.round("confidence", 6).alias("confidence"), "text_language", F.col("accepted").alias("kept"))


@query
def language_id_of_pages(spark: SparkSession, folder: str) -> DataFrame:
    pages = language_id.page_evidence(table(spark, folder, "pages"))
    done = language_id.identify(pages, "body", "declared", "host")
    return done.select(
        "page_id", "host", "declared", "language", F.round("confidence", 6).alias("confidence"), "text_language", "accepted"
    )


@query
def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign_shards(table(spark, folder, "documents"), limit=SHARD_BYTES)


SHARD_BYTES = 1 << 20
ORACLES["op2_sharding"] = f"""
WITH hashed AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes,
    substr(CAST(CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT) AS BIT) AS VARCHAR), 17) AS bits
  FROM documents
),
sums AS (
  SELECT substr(bits, 1, d) AS prefix, d, sum(n_bytes)::BIGINT AS shard_bytes
  FROM hashed, range(0, 40) AS r(d) GROUP BY ALL HAVING sum(n_bytes) <= {SHARD_BYTES}
),
best AS (
  SELECT doc_id, n_bytes, bits, min(d) AS depth
  FROM hashed JOIN sums ON substr(bits, 1, d) = prefix GROUP BY ALL
)
SELECT doc_id, n_bytes, prefix AS shard, depth::INTEGER AS depth, shard_bytes, true AS fits
FROM best JOIN sums ON substr(bits, 1, depth) = prefix AND depth = d
"""


@query
def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    done = quality.score(table(spark, folder, "documents"))
    return done.select("doc_id", *quality.METRICS, "base_failed", "kept", "n_common_words")


@query
def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op7_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.digests(secret_scan.find_secrets(table(spark, folder, "documents")))


@query
def op8_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data.digests(personal_data.find_personal_data(table(spark, folder, "documents")))


@query
def op3_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, folder, "documents"))


@query
def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    done = suffix_dedup.remove_repeats(table(spark, folder, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op11_centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return clustering.cluster(table(spark, folder, "embeddings"))


def _cluster_sql() -> str:
    """The rounds as one chain of tables."""
    parts = [
        """kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        "cells AS MATERIALIZED (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM kept)",
        """c0 AS MATERIALIZED (
  SELECT c, unnest(v) AS y, generate_subscripts(v, 1) AS i FROM (
    SELECT v, row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR), v) - 1 AS c FROM kept
    WHERE vec_id IS NOT NULL QUALIFY c < 8)
)""",
    ]
    for k in range(clustering.ROUNDS + 1):
        parts.append(
            f"""a{k} AS MATERIALIZED (
  SELECT r, min(d)::BIGINT AS distance, arg_min(c, (d, c))::INTEGER AS cluster
  FROM (SELECT r, c, sum((x - y) * (x - y)) AS d FROM cells JOIN c{k} USING (i) GROUP BY r, c) GROUP BY r
)"""
        )
        if k < clustering.ROUNDS:
            parts.append(
                f"""c{k + 1} AS MATERIALIZED (
  SELECT c, i, coalesce((s - ((s % n) + n) % n) // n, y)::BIGINT AS y FROM c{k} LEFT JOIN (
    SELECT cluster AS c, i, sum(x) AS s, count(*) AS n FROM cells JOIN a{k} USING (r) GROUP BY ALL) USING (c, i)
)"""
            )
    last = clustering.ROUNDS
    return f"""WITH {", ".join(parts)},
digests AS (SELECT c, sha256(string_agg(y::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{last} GROUP BY c)
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
  (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{last} JOIN kept USING (r) JOIN digests ON cluster = c
"""


ORACLES["op11_centroid_clusters"] = _cluster_sql()


@query
def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return source_audit.audit(table(spark, folder, "documents"))


ORACLES["op12_source_divergence"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source
  FROM documents
),
words AS (
  SELECT r, lang, source, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM docs)
),
terms AS (SELECT lang, term, count(*) AS total FROM words GROUP BY ALL HAVING count(DISTINCT r) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(total) AS lang_n FROM terms GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN terms USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, source, sum(n) AS group_n FROM counts GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
cells AS (
  SELECT lang, source, term, coalesce(n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (coalesce(group_n, 0) + 5 * v) AS p,
    1 + (1000000000::HUGEINT * (total + 5)) // (lang_n + 5 * v) AS q
  FROM groups JOIN terms USING (lang) JOIN langs USING (lang)
  LEFT JOIN counts USING (lang, source, term) LEFT JOIN sizes USING (lang, source)
),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
)
SELECT lang, source, 'pair' AS part, item, value,
  (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', term, (p - q)::BIGINT,
  (row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term))::INTEGER AS rank
FROM cells WHERE n > 0 AND p > q QUALIFY rank <= 50
"""


@query
def op13_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, folder, "documents"))
