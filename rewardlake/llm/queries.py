"""Registered queries of this folder: name -> (spark, sf_dir) -> DataFrame.

Each reads its whole table and calls its operator with production parameters.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rewardlake.llm import (ann, bpe, langid, mixing, packing, pii, quality, secret_scan, sharding,
                            simhash, spelling, token_align, topk)
from rewardlake.llm.common import F, load


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector against all others: 10 greatest integer inner products."""
    found = topk.exact_top_k(load(spark, sf_dir, "embeddings", "vec_id", "embedding"), 10,
                             F.pmod("vec_id", F.lit(100)) == 0, scale=1024.0)
    return found.withColumn("score", F.col("score").cast("long"))


def op2_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(load(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", "fingerprint", "component_id")


def op4_kmeans_tree_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector against all others: 20 nearest found by the tree."""
    return ann.neighbours(load(spark, sf_dir, "embeddings", "vec_id", "embedding"), 20,
                          F.pmod("vec_id", F.lit(20)) == 0)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document tokenised, cut and packed into sequences of 2,048 tokens."""
    return packing.pack_documents(load(spark, sf_dir, "documents", "doc_id", "text"),
                                  public_tokenizers.path("word_bpe_49k.json"))


def op5_language_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and verdict of every document: text, declared language and source."""
    rows = langid.document_evidence(load(spark, sf_dir, "documents", "doc_id", "text", "lang",
                                         "source"))
    return langid.identify(rows, "doc_id", langid.Fusion(rows))


def page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and verdict of every page: text, html declaration, address suffix and host."""
    rows = langid.page_evidence(load(spark, sf_dir, "pages", "page_id", "url", "html"))
    return langid.identify(rows, "page_id", langid.Fusion(rows))


def op6_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document; sources are the owners and documents the repositories."""
    found = secret_scan.scan(load(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex",
                        F.sha2(F.col("base_spans"), 256).alias("base_sha256"), "spans",
                        "n_live", "n_copied")


def op7_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score and verdict of every document."""
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    return quality.scored(docs, quality.fit(docs))


def op8_kd_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 24 shards of nearly equal bytes."""
    placed = sharding.shard_documents(load(spark, sf_dir, "documents", "doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                         "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_bpe_prefix_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded; digests of ids and decoded text."""
    return bpe.digests(load(spark, sf_dir, "documents", "doc_id", "text"),
                       public_tokenizers.path("byte_bpe_50k.json"))


def op10_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = pii.find(load(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone",
                        F.sha2(F.array_join("base_spans", ","), 256).alias("base_sha256"),
                        F.array_join("spans", ",").alias("spans"), "n_added")


def op11_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that a mix of 150 % of all words takes of it."""
    mixed = mixing.mix(load(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents, one run in 97 misspelt, with its form and root."""
    return spelling.variants(spelling.word_counts(
        load(spark, sf_dir, "documents", "doc_id", "text"), spoil=97))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in two tokenizers, aligned; links, groups and corpus counts of its id pairs."""
    return token_align.link_statistics(load(spark, sf_dir, "documents", "doc_id", "text"),
                                       public_tokenizers.path("byte_bpe_50k.json"),
                                       public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_exact_topk, op2_simhash_bktree, op4_kmeans_tree_ann, op3_best_fit_packing,
                                  op5_language_evidence, op6_secret_ownership, op7_weak_label_quality,
                                  op8_kd_tree_sharding, op9_bpe_prefix_dp,
                                  op10_pii_weak_supervision, page_language, op11_pivotal_mixing,
                                  op12_spelling_variants, op13_token_alignment)}
# crc32 of four bits, from its polynomial; the oracle takes a text's bits four by four.
CRC_OF_NIBBLE = []
for _c in range(16):
    for _ in range(4):
        _c = _c >> 1 ^ (0xEDB88320 if _c & 1 else 0)
    CRC_OF_NIBBLE.append(_c)

ORACLE: dict[str, str] = {
    "op1_exact_topk": """
        WITH v AS (
            SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
            FROM embeddings),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))
                        AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
        r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)
                           AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op12_spelling_variants": f"""
        WITH RECURSIVE runs AS (
            SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS id,
                   translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')),
                             '{spelling.UPPER}', '{spelling.LOWER}') AS run FROM documents),
        each AS (SELECT id, run, count(*) AS k, hex(encode(id || run)) AS x FROM runs
                 GROUP BY id, run),
        crc AS (
            SELECT run, k, xor(4294967295, list_reduce(list_prepend(4294967295, [
                       CAST(instr('0123456789ABCDEF', x[i + (i % 2) * 2 - 1]) - 1 AS BIGINT)
                       FOR i IN range(1, length(x) + 1)]),
                       lambda c, d: xor(c >> 4, {CRC_OF_NIBBLE}[(xor(c, d) & 15) + 1]))) AS h
            FROM each),
        words AS (
            SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run))
                             || substr(run, h % length(run) + 2) ELSE run END AS word,
                   CAST(sum(k) AS BIGINT) AS n
            FROM crc GROUP BY 1 HAVING sum(k) >= 3 AND length(word) >= 5),
        shorter AS (
            SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
            FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
        near AS (
            SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM shorter a JOIN shorter b
                ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
            UNION SELECT a.word, a.n, b.word, b.n FROM words a JOIN shorter b ON a.word = b.rest
            UNION SELECT b.word, b.n, a.word, a.n FROM words a JOIN shorter b ON a.word = b.rest),
        best AS (
            SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS r,
                   count(*) OVER (PARTITION BY word) AS n_near FROM near),
        top AS (
            SELECT word, n_near, CASE WHEN near_n >= 2 * n THEN near END AS form,
                   CASE WHEN near_n >= 2 * n THEN near_n END AS form_n FROM best WHERE r = 1),
        chain AS (
            SELECT word, word AS at FROM words
            UNION ALL SELECT c.word, t.form FROM chain c JOIN top t ON t.word = c.at
            WHERE t.form IS NOT NULL),
        ends AS (
            SELECT c.word, c.at FROM chain c LEFT JOIN top t ON t.word = c.at
            WHERE t.form IS NULL)
        SELECT w.word, t.form, e.at AS root, w.n, CAST(coalesce(t.n_near, 0) AS BIGINT) AS n_near,
               CAST(t.form_n AS BIGINT) AS form_n
        FROM words w LEFT JOIN top t ON t.word = w.word JOIN ends e ON e.word = w.word""",
}
