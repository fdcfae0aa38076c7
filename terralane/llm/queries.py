"""The registered queries of this folder; each one derives a digest from its operator."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe_automaton,
    fingerprint,
    host_graph,
    image_descriptors,
    language_id,
    merkle,
    near_dedup,
    packing,
    pii,
    sharding,
)
from .common import documents, small_batches


def op1_one_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_neighbours(documents(spark, sf_dir))


def op2_host_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_graph.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return judged.withColumns({c: F.round(c, 4) for c in ("trust", "distrust")})


def _op2_sql() -> str:
    """Rules, host links and the walks, round by round."""
    host = "translate(coalesce(regexp_extract({u}, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = "coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '')"
    rules = sorted(host_graph.RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')" for _, h, p in rules]
    arms = lambda of: " ".join(f"WHEN {c} THEN '{of(r)}'" for c, r in zip(fits, rules, strict=True))
    damping = host_graph.DAMPING
    rounds = math.ceil(math.log(host_graph.RESIDUAL) / math.log(damping)) + 4
    href = r"""(?i)\bhref\s*=\s*["'']?\s*((?:https?:)?//[^"''\s>]+)"""
    link = "CASE WHEN starts_with(l, '//') THEN 'http:' || l ELSE l END"
    return f"""WITH RECURSIVE named AS (
  SELECT page_id, {host.format(u="url")} AS host, {path} AS path, html FROM pages
), ruled AS (
  SELECT page_id, host, path, html, CASE {arms(lambda r: r[1] + r[2])} END AS rule, CASE {arms(lambda r: r[0])} END AS ruled FROM named
), seeds AS (
  SELECT host, count(*) AS pages, count(*) FILTER (ruled = 'allow') AS trusted, count(*) FILTER (ruled = 'block') AS blocked
  FROM ruled WHERE host <> '' GROUP BY 1
), hrefs AS (
  SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '{href}', 1)) AS l FROM named
), linked AS (
  SELECT src, dst, count(*) AS n FROM (SELECT src, {host.format(u=link)} AS dst FROM hrefs) GROUP BY 1, 2
), above AS (
  SELECT n, array_to_string(parts[i:], '.') AS low, array_to_string(parts[i + 1:], '.') AS high
  FROM (SELECT pages AS n, string_split(host, '.') AS parts, unnest(range(1, len(string_split(host, '.')) - 1)) AS i FROM seeds)
), edges AS (
  SELECT src, dst, sum(n) AS n FROM (
    SELECT src, dst, n FROM linked UNION ALL SELECT low, high, n FROM above UNION ALL SELECT high, low, n FROM above
  ) WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY 1, 2
), ways AS (
  SELECT src, dst, n, way FROM edges, (VALUES ('trust'), ('pages')) t(way)
  UNION ALL SELECT dst, src, n, way FROM edges, (VALUES ('distrust'), ('back')) t(way)
), shares AS (
  SELECT src, dst, way, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY src, way) AS share FROM ways
), moving AS (
  SELECT 0 AS i, host, way, {1 - damping!r}::DOUBLE * c / (SELECT sum(pages) FROM seeds) AS score
  FROM (SELECT host, unnest(['trust', 'pages', 'distrust', 'back']) AS way, unnest([trusted, pages, blocked, pages]) AS c FROM seeds)
  UNION ALL
  SELECT w.i + 1, s.dst, s.way, sum({damping}::DOUBLE * share * score) FROM shares s JOIN moving w ON w.host = s.src AND w.way = s.way
  WHERE w.i < {rounds} GROUP BY ALL
), mass AS (
  SELECT host, coalesce(sum(score) FILTER (way = 'trust'), 0) AS t, sum(score) FILTER (way = 'pages') AS p,
         coalesce(sum(score) FILTER (way = 'distrust'), 0) AS d, sum(score) FILTER (way = 'back') AS b FROM moving GROUP BY 1
), scores AS (
  SELECT host, coalesce(t / nullif(p, 0), 0) AS trust, coalesce(d / nullif(b, 0), 0) AS distrust FROM mass
)
SELECT page_id, host, path, rule,
       coalesce(ruled, CASE WHEN coalesce(distrust, 0) - coalesce(trust, 0) >= {host_graph.THRESHOLD!r}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict,
       round(coalesce(trust, 0), 4) AS trust, round(coalesce(distrust, 0), 4) AS distrust
FROM ruled LEFT JOIN scores USING (host)"""


def op3_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images drawn from all vectors, with edited copies of the ids that 50 divides."""
    small_batches(spark)
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return image_descriptors.image_copies(image_descriptors.render(vectors))


def op4_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), shingle_words=4)


def op5_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.encode_decode(documents(spark, sf_dir), keep_payload=False)


def op6_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), keep_ids=False)


def op7_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages against a replica that lost, changed and gained some records."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    at = F.col("page_id") % 211
    replica = (
        pages.where(at != 17)
        .withColumn("html", F.when(at == 5, F.concat("html", F.lit(" "))).otherwise(F.col("html")))
        .unionByName(pages.where(at == 99).withColumn("page_id", -1 - F.col("page_id")))
    )
    levels = merkle.levels_for(pages, replica)
    found = merkle.audit(merkle.tree(pages, levels), merkle.tree(replica, levels), levels)
    return found.withColumnRenamed("place", "page_id")


_RECORD = (
    "'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || "
    "'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || "
    "strlen(coalesce({html}, '')) || chr(13) || chr(10) || chr(13) || chr(10) || "
    "coalesce({html}, '') || chr(13) || chr(10) || chr(13) || chr(10)"
)
OP7_SQL = f"""
WITH own AS (
  SELECT page_id, {_RECORD.format(html="html")} AS record FROM pages
), copy AS (
  SELECT page_id, {_RECORD.format(html="CASE WHEN page_id % 211 = 5 THEN html || ' ' ELSE html END")} AS record
  FROM pages WHERE page_id % 211 <> 17
  UNION ALL SELECT -1 - page_id, record FROM own WHERE page_id % 211 = 99
), a AS (
  SELECT page_id, sha256(record) AS first_hash,
         CAST(sum(strlen(record)) OVER (ORDER BY page_id) - strlen(record) AS BIGINT) AS first_offset FROM own
), b AS (
  SELECT page_id, sha256(record) AS second_hash,
         CAST(sum(strlen(record)) OVER (ORDER BY page_id) - strlen(record) AS BIGINT) AS second_offset FROM copy
)
SELECT page_id, CASE WHEN second_hash IS NULL THEN 'missing' WHEN first_hash IS NULL THEN 'extra' ELSE 'changed' END AS status,
       first_hash, second_hash, first_offset, second_offset
FROM a FULL JOIN b USING (page_id) WHERE first_hash IS DISTINCT FROM second_hash
"""


def op9_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op8_language_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    models = language_id.learn(docs.where(~language_id.held_out()))
    found = language_id.identify(docs.select("doc_id", "text"), models)
    return found.select(
        "doc_id",
        F.coalesce(language_id.held_out(), F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
        "margin",
        "rejected",
    )


def op10_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(documents(spark, sf_dir)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_one_permutation": op1_one_permutation,
        "op2_host_graph": op2_host_graph,
        "op3_image_copies": op3_image_copies,
        "op4_superminhash": op4_superminhash,
        "op5_bpe_automaton": op5_bpe_automaton,
        "op6_pack_windows": op6_pack_windows,
        "op7_merkle_audit": op7_merkle_audit,
        "op8_language_compression": op8_language_compression,
        "op9_minimax_shards": op9_minimax_shards,
        "op10_bootstrapped_pii": op10_bootstrapped_pii,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_host_graph": _op2_sql(), "op7_merkle_audit": OP7_SQL}
