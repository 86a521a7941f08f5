"""The registered queries of the text operators and their oracle SQL."""

from __future__ import annotations

from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import remainder
from tidemark.llm import decontaminate, exact_dedup, filter_audit, html_extract, language_id, mixing, near_dedup, piece_encoding, sharding, substring_dedup, token_count, toxicity, whitening


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: At most about so many labelled rows are read to learn the language filters and the toxic terms.
SAMPLE_ROWS = 20_000


def op1_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds, exactly or edited."""
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of near equal bytes."""
    shards = sharding.kd_shards(_table(spark, sf_dir, "documents"), 8)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; learned where crc32 of the id modulo 3 is not 1."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, toxicity.training_labels(_table(spark, sf_dir, "labels")), SAMPLE_ROWS)
    return toxicity.score(docs.withColumn("held_out", remainder("doc_id", 3) == 1), model, keep=["held_out"])


def op4_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document equals after white space is normalised."""
    return exact_dedup.exact_duplicates(spark, f"{sf_dir}/documents.parquet").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document holds too."""
    return substring_dedup.repeats(_table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the word-level vocabulary."""
    import public_tokenizers

    return token_count.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@cache
def page_weights() -> html_extract.Weights:
    """The weights that ``tidemark.llm.labelled_pages`` has learned from made pages."""
    return html_extract.Weights.read(Path(__file__).with_name("page_weights.json"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"), page_weights())


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix 1 : 2 : 3 takes from every document."""
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "shard", "block", "quota")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents under 3-word shingles and similarity 0.85."""
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), size=3, percent=85)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned where crc32 of the id modulo 4 is not 2."""
    docs = _table(spark, sf_dir, "documents")
    labelled = docs.where("lang is not null and text is not null").where(remainder("doc_id", 4) != 2)
    filters = language_id.learn(language_id.sample(labelled, SAMPLE_ROWS))
    held_out = docs.withColumn("held_out", remainder("doc_id", 4) == 2)
    return language_id.identify(held_out, filters, keep=["held_out"])


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes from every source, in all 120 orders."""
    return filter_audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings in whitened components."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_piece_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document under the piece vocabulary, and the text that they give back."""
    import public_tokenizers

    return piece_encoding.encode_texts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    "op1_benchmark_leaks": op1_benchmark_leaks,
    "op2_kd_shards": op2_kd_shards,
    "op3_toxicity": op3_toxicity,
    "op4_exact_duplicates": op4_exact_duplicates,
    "op5_repeated_passages": op5_repeated_passages,
    "op6_token_counts": op6_token_counts,
    "op7_main_text": op7_main_text,
    "op8_mix_sources": op8_mix_sources,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_language": op10_language,
    "op11_filter_audit": op11_filter_audit,
    "op12_whitening": op12_whitening,
    "op13_piece_ids": op13_piece_ids,
}

ORACLE_SQL: dict[str, str] = {
    "op4_exact_duplicates": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM d""",
    "op8_mix_sources": r"""
        WITH d AS (SELECT doc_id AS id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size, md5(coalesce(text, '')) AS digest FROM documents),
        w AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS docs, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM d GROUP BY source),
        v AS (SELECT *, nth % 3 + 1 AS weight, 3 * source_size AS cap FROM w),
        r AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS share
              FROM v WINDOW b AS (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        f AS (SELECT cap / weight AS edge, rest, share FROM r WHERE rest::DOUBLE / share <= cap / weight ORDER BY cap / weight, nth LIMIT 1),
        t AS (SELECT source, source_size, ceil(docs / 20000)::BIGINT AS shards,
              CASE WHEN cap / weight < edge THEN cap::DOUBLE ELSE least(cap::DOUBLE, weight * f.rest::DOUBLE / f.share) END AS target FROM r CROSS JOIN f),
        p AS (SELECT *, greatest(1, floor(min(target) FILTER (WHERE target > 0) OVER () / 1000))::BIGINT AS block FROM t),
        e AS (SELECT d.*, source_size, target, block, ('0x' || substr(md5('17:shard:' || id), 1, 8))::BIGINT % shards AS shard,
              ('0x' || substr(md5('17:draw:' || id), 1, 8))::BIGINT AS draw FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
        s AS (SELECT source, shard, sum(size)::BIGINT AS words, any_value(source_size) AS source_size, any_value(block) AS block,
              round(any_value(target) / any_value(block))::BIGINT AS seats, count(*) OVER (PARTITION BY source) AS n FROM e GROUP BY source, shard),
        q AS (SELECT *, ceil(words / block)::BIGINT AS blocks, coalesce(words::DOUBLE / nullif(source_size, 0), 0) AS part FROM s),
        b AS (SELECT *, least(greatest(0, ceil(part * (seats - n / 2) - 0.5)), 3 * blocks)::BIGINT AS low, least(greatest(0, floor(part * (seats + n / 2) + 0.5)), 3 * blocks)::BIGINT AS high FROM q),
        k AS (SELECT source, shard, words, unnest(range(low + 1, high + 1)) AS k FROM b),
        o AS (SELECT source, any_value(seats) - sum(low) AS free FROM b GROUP BY source),
        won AS (SELECT k.source, shard, count(*) AS won FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY words::DOUBLE / (2 * k - 1) DESC, shard, k) AS place FROM k) k
              JOIN o ON k.source IS NOT DISTINCT FROM o.source WHERE place <= free GROUP BY k.source, shard),
        u AS (SELECT b.source, b.shard, words, blocks, low + coalesce(won, 0) AS quota FROM b LEFT JOIN won ON b.source IS NOT DISTINCT FROM won.source AND b.shard = won.shard),
        x AS (SELECT e.*, blocks, quota, sum(size) OVER (PARTITION BY e.source, e.shard ORDER BY draw, id, size, digest ROWS UNBOUNDED PRECEDING)::BIGINT AS fin,
              ('0x' || substr(md5('17:start:' || coalesce(e.source, '') || ':' || e.shard), 1, 8))::BIGINT % greatest(blocks, 1) AS lo
              FROM e JOIN u ON e.source IS NOT DISTINCT FROM u.source AND e.shard = u.shard),
        y AS (SELECT *, fin - size AS beg, CASE WHEN blocks > 0 THEN quota // blocks ELSE 0 END AS rounds, CASE WHEN blocks > 0 THEN quota % blocks ELSE quota END AS extra FROM x)
        SELECT id AS doc_id, size, source_size, target,
               (rounds * size + greatest(0, least(fin, least(lo + extra, blocks) * block) - greatest(beg, lo * block)) + greatest(0, least(fin, greatest(lo + extra - blocks, 0) * block) - beg))::BIGINT AS taken,
               shard, block, quota::BIGINT AS quota
        FROM y""",
    "op11_filter_audit": r"""
        WITH l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
        d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
        m AS (SELECT part, (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT + 4 * (100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 2 * length(t))::INT
              + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > first, false)::INT AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
        c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2),
        f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
        o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e WHERE (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
        s AS (SELECT filter_order, k AS step, bits[k] AS bit, coalesce(list_sum(bits[1:k - 1]), 0)::INT AS before FROM o, range(1, 6) r(k)),
        x AS (SELECT part, filter_order, step::INT AS step, bit, coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS removed,
              coalesce(sum(n) FILTER (mask & before > 0 AND mask & bit > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
              coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS toxic_lost
              FROM c CROSS JOIN s GROUP BY 1, 2, 3, 4)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM x""",
}
