"""The named queries of this subpackage over the given tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewright.llm import (
    attribution,
    best_fit,
    decontaminate,
    lines,
    merkle,
    negatives,
    packing,
    secret_scan,
    simhash,
    sketches,
    substrings,
    toxicity,
    warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.fingerprint_edits(table(spark, sf_dir, "documents"))


@query
def op3_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.without_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256")
    )


@query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


@query
def op7_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(*warc.archive_pages(table(spark, sf_dir, "pages")))


@query
def op8_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.attribute_tokens(table(spark, sf_dir, "documents"), attribution.line_sections("text"))


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified_manifest(table(spark, sf_dir, "documents"))


@query
def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(table(spark, sf_dir, "documents"))


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(negatives.scaled(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


CHECKS["op4_substring_dedup"] = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), p AS (
  SELECT doc_id, words, unnest(generate_series(1, len(words) - 49)) AS i FROM w WHERE len(words) >= 50
), g AS (
  SELECT doc_id, i, array_to_string(list_slice(words, i, i + 49), ' ') AS g FROM p
), f AS (
  SELECT g, min(doc_id) AS first FROM g GROUP BY g
), c AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS i FROM g JOIN f USING (g) WHERE doc_id > first
), k AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w
), m AS (
  SELECT k.doc_id, k.i, k.word, c.i IS NOT NULL AS gone FROM k LEFT JOIN c ON k.doc_id = c.doc_id AND k.i = c.i
), r AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
         string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept
  FROM m GROUP BY doc_id
)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN r ON w.doc_id = r.doc_id
"""

CHECKS["op5_line_dedup"] = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), r AS (
  SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.*, coalesce(k.doc_id < r.holder, false) AS gone FROM k LEFT JOIN r USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

CHECKS["op7_warc_zstd"] = """
WITH d AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha1(coalesce(html, '')) AS digest FROM pages
), f AS (
  SELECT digest, max(page_id) AS first FROM d WHERE n >= 1000 GROUP BY digest
)
SELECT page_id, n AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN page_id < f.first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < f.first THEN f.first END AS refers_to
FROM d LEFT JOIN f ON d.digest = f.digest AND n >= 1000
"""

CHECKS["op11_merkle_manifest"] = """
WITH RECURSIVE d AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS grp,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         CAST(n_chars AS HUGEINT) AS n_chars, coalesce(strlen(text) || ':' || text, '-') AS tail,
         list_reduce(
           list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
           lambda a, b: list_reduce(
             list_prepend(xor(a, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
             lambda r, z: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END
           )
         ) AS crc
  FROM documents
), e AS (
  SELECT doc_id, grp, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
         CASE WHEN xor(crc, 4294967295) % 7 = 0
              THEN sha256(head || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail) END AS changed
  FROM d
), p AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY grp) AS n FROM e
), t(grp, lvl, i, h, n) AS (
  SELECT grp, 0, place, leaf, n FROM p
  UNION ALL
  SELECT grp, lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY grp, lvl, i // 2, n
), g AS (
  SELECT grp, h AS subroot, lvl AS height, row_number() OVER (ORDER BY grp) - 1 AS place, count(*) OVER () AS n FROM t WHERE n = 1
), u(lvl, i, h, n) AS (
  SELECT 0, place, subroot, n FROM g
  UNION ALL
  SELECT lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY lvl, i // 2, n
), s AS (
  -- the node beside each ancestor of a leaf, empty where it is alone in its run
  SELECT p.grp, p.place, t.lvl, t.i % 2 = 1 AS right_node, coalesce(b.h, '') AS sibling
  FROM p JOIN t ON t.grp = p.grp AND t.n > 1 AND t.i = p.place // CAST(pow(2, t.lvl) AS BIGINT)
  LEFT JOIN t b ON b.grp = t.grp AND b.lvl = t.lvl AND b.i = xor(t.i, 1)
  UNION ALL
  SELECT p.grp, p.place, g.height + u.lvl, u.i % 2 = 1, coalesce(b.h, '')
  FROM p JOIN g ON g.grp = p.grp JOIN u ON u.n > 1 AND u.i = g.place // CAST(pow(2, u.lvl) AS BIGINT)
  LEFT JOIN u b ON b.lvl = u.lvl AND b.i = xor(u.i, 1)
), f(grp, place, lvl, h) AS (
  SELECT grp, place, 0, coalesce(changed, leaf) FROM p
  UNION ALL
  SELECT f.grp, f.place, f.lvl + 1, sha256(CASE WHEN right_node THEN sibling || h ELSE h || sibling END)
  FROM f JOIN s ON s.grp = f.grp AND s.place = f.place AND s.lvl = f.lvl
), o AS (
  SELECT grp, place, arg_max(h, lvl) AS folded_root FROM f GROUP BY grp, place
), x AS (
  SELECT grp, place, sha256(string_agg(sibling, '' ORDER BY lvl)) AS proof_sha256 FROM s GROUP BY grp, place
)
SELECT p.doc_id, p.leaf, g.subroot, u.h AS root, coalesce(x.proof_sha256, sha256('')) AS proof_sha256, o.folded_root,
       o.folded_root = u.h AS verified
FROM p JOIN g ON g.grp = p.grp JOIN u ON u.n = 1 JOIN o ON o.grp = p.grp AND o.place = p.place
LEFT JOIN x ON x.grp = p.grp AND x.place = p.place
"""

CHECKS["op13_hard_negatives"] = """
WITH e AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
), n AS (
  SELECT p.anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
