"""Queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

import hashlib

import corpus_pipeline
from pyspark.sql import functions as F

from . import bwt_dedup, codebooks, decontaminate, line_dedup, maxent_lm, packing, periodic_runs, pii, quality, sharding, simhash, token_counts, topk

QUERIES = {}
ORACLES = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return deco


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SHARDS = 24

# The CRC table is built from its polynomial (eight shift steps a byte); the CRC folds a text's bytes through it.
OP1_SQL = f"""
WITH RECURSIVE steps(b, v, i) AS (
    SELECT range, range, 0 FROM range(256)
    UNION ALL
    SELECT b, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, i + 1 FROM steps WHERE i < 8),
crc AS (SELECT list(v ORDER BY b) AS t FROM steps WHERE i = 8),
d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS key, encode(coalesce(text, '')) AS body FROM documents),
summed AS (
    SELECT doc_id, key, CAST(octet_length(body) + 8 AS BIGINT) AS size,
           xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
                   list_transform(regexp_extract_all(hex(body), '..'), lambda h: CAST('0x' || h AS BIGINT))),
               lambda a, x: xor(a // 256, t[CAST(xor(a % 256, x) AS INTEGER) + 1])), 4294967295) AS text_crc32
    FROM d, crc),
scores AS (
    SELECT *, list_transform(range({SHARDS + 1}), lambda s:
               -1.0 / ln((CAST('0x' || substr(md5(key || '#' || s), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)) AS score
    FROM summed),
placed AS (
    SELECT doc_id, size, text_crc32,
           CAST(list_position(score[1:{SHARDS}], list_max(score[1:{SHARDS}])) - 1 AS INTEGER) AS shard,
           CAST(list_position(score, list_max(score)) - 1 AS INTEGER) AS grown_shard
    FROM scores)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id, size, text_crc32) - 1 AS slot, grown_shard
FROM placed
"""


@register("op1_rendezvous_shards", OP1_SQL)
def op1(spark, sf_dir):
    """All documents into shards 0 to 23, law ``key``."""
    return sharding.assign_shards(table(spark, sf_dir, "documents"), [1.0] * SHARDS)


@register("op2_repeated_strings")
def op2(spark, sf_dir):
    """Every document without the bytes of 50-byte strings that a smaller id also has."""
    return bwt_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_kept=False).drop("kept")


TOKEN_LIMIT = 2048


@register("op3_token_counts")
def op3(spark, sf_dir):
    """Tokens of every whole text by word_bpe_49k.json."""
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), TOKEN_LIMIT)


@register("op6_exact_top_k", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q
           FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
             vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""")
def op6(spark, sf_dir):
    """Five best integer inner products of every 50th vector over all others."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


@register("op9_simhash_groups")
def op9(spark, sf_dir):
    """SimHash fingerprints and components at 3 or fewer bits, 3-word shingles."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, max_bits=3)


@register("op4_line_runs")
def op4(spark, sf_dir):
    """Every document with the later copies of repeated line runs, and of all runs of 50 or more words, deleted."""
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), words=line_dedup.RUN)
    return done.select("doc_id", "n_units_cut", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("kept_sha256"))


@register("op5_best_fit_bins")
def op5(spark, sf_dir):
    """Every piece of every document in a bin of 32,768 bytes."""
    return packing.pack(table(spark, sf_dir, "documents"))


@register("op7_benchmark_leaks")
def op7(spark, sf_dir):
    """Documents that hold a benchmark item, with the item and the overlaps."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op8_quality_rules")
def op8(spark, sf_dir):
    """Quality score of every document by the sparse rule ensemble."""
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op10_maxent_lm")
def op10(spark, sf_dir):
    """Log10 probability of every whole text by the maximum-entropy model, beside the unigram base."""
    return maxent_lm.score_texts(table(spark, sf_dir, "documents"))


PARTS, ENTRIES, ROUNDS = 4, 256, 4


def _op11_sql() -> str:
    """Each round's assignment and update as one CTE each; a struct's minimum breaks ties by the lower entry."""
    assign = """a{r} AS MATERIALIZED (
    SELECT x.rid, x.part, min({{'dist': CAST(list_inner_product(x.q, x.q) - 2 * list_inner_product(x.q, b.q)
                                        + list_inner_product(b.q, b.q) AS BIGINT), 'entry': b.entry}}) AS best
    FROM parts x JOIN b{r} b ON x.part = b.part GROUP BY ALL)"""
    update = """b{n} AS MATERIALIZED (
    WITH used AS (SELECT part, entry, list(mean ORDER BY pos) AS q FROM (
        SELECT part, entry, pos, floor(sum(v) / count(*)) AS mean FROM (
            SELECT x.part, a.best.entry AS entry, generate_subscripts(x.q, 1) AS pos, unnest(x.q) AS v
            FROM parts x JOIN a{r} a ON x.rid = a.rid AND x.part = a.part) GROUP BY ALL) GROUP BY ALL)
    SELECT b.part, b.entry, coalesce(u.q, b.q) AS q FROM b{r} b LEFT JOIN used u ON b.part = u.part AND b.entry = u.entry)"""
    rounds = [x.format(r=r, n=r + 1) for r in range(ROUNDS) for x in (assign, update)] + [assign.format(r=ROUNDS)]
    return f"""
WITH v AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS rid, vec_id, label,
           list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q
    FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
    SELECT rid, part, q[(len(q) * part // {PARTS}) + 1:len(q) * (part + 1) // {PARTS}] AS q
    FROM v, (SELECT range AS part FROM range({PARTS}))),
b0 AS MATERIALIZED (SELECT part, rid AS entry, q FROM parts WHERE rid < {ENTRIES}),
{("," + chr(10)).join(rounds)},
coded AS (
    SELECT rid, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, CAST(sum(best.dist) AS BIGINT) AS error
    FROM a{ROUNDS} GROUP BY rid),
books AS (
    SELECT sha256(string_agg(CAST(CAST(c AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256
    FROM (SELECT part, entry, generate_subscripts(q, 1) AS pos, unnest(q) AS c FROM b{ROUNDS}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM v JOIN coded USING (rid), books
"""


@register("op11_vector_codes", _op11_sql())
def op11(spark, sf_dir):
    """Every usable vector as four codes of one byte, with its error and its label's."""
    made = codebooks.compress(table(spark, sf_dir, "embeddings"), PARTS, ENTRIES, ROUNDS)
    code = F.lower(F.concat_ws("", F.transform("codes", lambda c: F.lpad(F.hex(c), 2, "0"))))
    sha = hashlib.sha256(codebooks.listing(made.codebooks).encode()).hexdigest()
    return codebooks.with_label_error(made.rows).select("vec_id", code.alias("code"), "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


@register("op12_periodic_runs")
def op12(spark, sf_dir):
    """Periodic runs of words of every text; every tenth document repeats a stretch of its own first (``h % 10 = 0``)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.size(F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0)))
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    docs = table(spark, sf_dir, "documents")
    docs = docs.withColumn("text", F.when(F.col("doc_id").isNotNull() & (h % 10 == 0) & (n > 0), periodic_runs.looped(F.col("text"), a, p)).otherwise(F.col("text")))
    best = periodic_runs.strongest("runs")
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat_ws("", F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    return (periodic_runs.find_runs(docs).withColumn("best", best)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                    F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
                    F.sha2(lines, 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256")))


@register("op13_personal_data")
def op13(spark, sf_dir):
    """Personal data in every text: the base patterns' counts and digest, and all spans with those the model adds."""
    found = pii.find_personal_data(table(spark, sf_dir, "documents"), pii.labelled_examples(spark))
    counts = [F.size(F.filter("base.kind", lambda kind: kind == k)).cast("long").alias(f"n_{k}") for k in pii.KINDS]  # noqa: B023
    return found.select("doc_id", *counts, F.sha2(pii.written("base"), 256).alias("base_sha256"), pii.written("spans").alias("spans"))


@register("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf_dir):
    """The corpus pipeline over all documents: bins of what it keeps."""
    return corpus_pipeline.run(spark, sf_dir)
