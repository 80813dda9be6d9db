"""The registered queries of this package: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docvec.llm import bitslices, bpe, dedup, fingerprint, licenses, mixing, neighbours, packing, pii, secrets, toxicity, warc, whitening
from docvec.llm.common import fold, table
from docvec.scratch import scratch_path


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_phrase_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.phrase_fingerprints(table(spark, sf_dir, "documents"))


def op2_tile_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op3_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold("doc_id") != 0)
    rows = docs.select("doc_id", (fold("doc_id") == 0).alias("held_out"), toxicity.scored(F.col("text"), model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.score(table(spark, sf_dir, "documents"), fold("doc_id") == 1)


def op7_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op8_odd_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_diagonal_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_disclosure_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op11_polarised_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_bitsliced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = bitslices.build(table(spark, sf_dir, "documents"))
    return bitslices.search(index, table(spark, sf_dir, "benchmark"))


def op13_warc_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_phrase_fingerprint,
        op2_tile_neighbours,
        op3_kernel_toxicity,
        op4_forced_boundary_bpe,
        op5_length_buckets,
        op6_context_mixing,
        op7_entropy_secrets,
        op8_odd_sketch_dedup,
        op9_diagonal_licenses,
        op10_disclosure_pii,
        op11_polarised_whitening,
        op12_bitsliced_search,
        op13_warc_members,
    )
}

# Fixed values, spelled out again: the characters of a term after A-Z are lower-cased.
_TERM = r"[0-9a-z\x{80}-\x{10FFFF}]+"


def _terms(text: str) -> str:
    lower = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"regexp_extract_all({lower}, '{_TERM}')"


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]))"


ORACLES: dict[str, str] = {
    "op2_tile_neighbours": f"""WITH used AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
sized AS (SELECT vec_id, v, sqrt({_dot('v', 'v')}) AS size FROM used),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, {_dot('q.v', 'c.v')} / (q.size * c.size) AS score
  FROM sized q JOIN sized c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM pairs QUALIFY rank <= 5""",
    "op8_odd_sketch_dedup": r"""WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
tokens AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM words),
runs AS (SELECT doc_id, t || ' ' || lead(t, 1) OVER d || ' ' || lead(t, 2) OVER d || ' ' || lead(t, 3) OVER d || ' ' || lead(t, 4) OVER d AS g
  FROM tokens WINDOW d AS (PARTITION BY doc_id ORDER BY i)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM words WHERE len(w) BETWEEN 1 AND 4),
pieces AS MATERIALIZED (SELECT DISTINCT doc_id, g FROM runs WHERE g IS NOT NULL),
sets AS MATERIALIZED (SELECT words.doc_id, count(g) AS n FROM words LEFT JOIN pieces USING (doc_id) GROUP BY ALL),
shingles AS MATERIALIZED (SELECT doc_id, n, g FROM pieces JOIN sets USING (doc_id)),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n - count(*) AS either, count(*) AS n_both FROM shingles a
  JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n),
one_way AS MATERIALIZED (SELECT a, b FROM shared WHERE 100 * n_both >= 75 * either),
links AS MATERIALIZED (SELECT a, b FROM one_way UNION ALL SELECT b, a FROM one_way),
reached AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a),
least AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least ON a = doc_id""",
    "op12_bitsliced_search": f"""WITH held AS (
  SELECT r, doc_id, t, count(*) AS tf FROM (
    SELECT row_number() OVER () AS r, doc_id, unnest({_terms('text')}) AS t FROM documents) GROUP BY ALL),
sizes AS (SELECT r, doc_id, sum(tf)::BIGINT AS n FROM held GROUP BY ALL),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
weights AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM held, totals GROUP BY t, docs),
asked AS (SELECT DISTINCT i, item_id, t FROM (
  SELECT row_number() OVER () AS i, item_id, unnest({_terms('text')}) AS t FROM benchmark)),
scores AS (
  SELECT i, item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN weights USING (t) JOIN held USING (t) JOIN sizes USING (r, doc_id), totals GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10""",
    "op13_warc_members": """WITH payloads AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT payload_digest, min(page_id) AS first FROM payloads WHERE payload_bytes >= 100 GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id IS DISTINCT FROM coalesce(first, page_id) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM coalesce(first, page_id) THEN first END AS refers_to
FROM payloads LEFT JOIN firsts USING (payload_digest)""",
}
