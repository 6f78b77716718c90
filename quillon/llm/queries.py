"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import backoff, embedding_dedup, jaccard, kneser_ney, mixing, quality_rules, toxicity
from quillon.llm.common import read_table, scratch
from quillon.llm.packing import pack
from quillon.llm.sharding import ShardStore
from quillon.llm.token_counts import token_counts


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(read_table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents arrive, in three parts, each as small shards, which are merged after each."""
    docs = read_table(spark, sf_dir, "documents")
    store = ShardStore(spark, scratch(spark, "shards"))
    for k in range(3):
        store.append(docs.filter(F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(3)), F.lit(0)) == k), rows_per_shard=4096)
        store.compact()
    return store.read().select("doc_id", "lang", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.is_held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(read_table(spark, sf_dir, "documents"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.score(read_table(spark, sf_dir, "documents"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link(read_table(spark, sf_dir, "embeddings"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_sharding": op2_sharding,
    "op3_quality_rules": op3_quality_rules,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_toxicity": op5_toxicity,
    "op6_mixing": op6_mixing,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_best_fit_packing": op10_best_fit_packing,
}

#: The same results in plain SQL, where SQL can say them: op3's score, op4 and op5 are trained on hashed features,
#: op9 and op10 need a tokenizer.
ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 5 * c >= 4 * (a.n + b.n - c)),
        e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        r AS (WITH RECURSIVE r AS (SELECT doc_id AS d, doc_id AS t FROM documents UNION SELECT r.d, e.y FROM r JOIN e ON e.x = r.t) SELECT d, min(t) AS least FROM r GROUP BY d)
        SELECT doc_id, least AS class_id, (SELECT count(*) FROM e WHERE e.x = doc_id) AS n_links, doc_id = least AS kept
        FROM documents JOIN r ON r.d = doc_id""",
    "op2_sharding": "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents",
    "op6_mixing": r"""
        WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
        per AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k, count(*) OVER () AS n FROM s GROUP BY source),
        w AS (SELECT *, (1 + k % 3)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap, sum(source_size) OVER ()::DOUBLE AS words FROM per),
        v AS (
            SELECT *, (words - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
            FROM w WINDOW before AS (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        f AS (SELECT arg_min(level, (cap / weight, k)) AS level FROM v WHERE level * weight <= cap),
        t AS (
            SELECT source, source_size, least(cap, coalesce(f.level * weight, cap)) AS target,
                CASE WHEN n > 1 THEN 0.8 * (1 - 2 * k / (n - 1)) ELSE 0 END AS slope FROM v LEFT JOIN f ON true),
        d AS (
            SELECT doc_id, size, source_size, target, s.source, slope, round(target)::BIGINT AS whole,
                coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY md5(concat_ws(':', doc_id, size))[1:15], doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
            FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
        u AS (SELECT *, CASE WHEN source_size > 0 THEN whole // source_size ELSE 0 END AS rounds, CASE WHEN target > 0 THEN least(1.0, start / target) ELSE 0 END AS u FROM d)
        SELECT doc_id, size::BIGINT AS size, source_size, target, (rounds * size + greatest(0, least(size, whole - rounds * source_size - start)))::BIGINT AS taken, source,
            CASE WHEN u = 0 THEN 0 ELSE 2 * u / (1 - slope + sqrt((1 - slope) * (1 - slope) + 4 * slope * u)) END AS position
        FROM u""",
    "op7_lm_scoring": r"""
        WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        tok AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM t),
        p AS (SELECT r, w, lag(w) OVER d AS v, lag(w, 2) OVER d AS u FROM tok WINDOW d AS (PARTITION BY r ORDER BY i)),
        own3 AS (SELECT r, u, v, w, count(*) AS n FROM p GROUP BY ALL),
        own2 AS (SELECT r, v, w, count(*) AS n FROM p GROUP BY ALL),
        c3 AS (SELECT u, v, w, sum(n) AS c FROM own3 WHERE u IS NOT NULL GROUP BY ALL),
        f2 AS (SELECT u, v, sum(n) AS c FROM own3 WHERE u IS NOT NULL GROUP BY ALL),
        c2 AS (SELECT v, w, sum(n) AS c FROM own2 WHERE v IS NOT NULL GROUP BY ALL),
        f1 AS (SELECT v, sum(n) AS c FROM own2 WHERE v IS NOT NULL GROUP BY v),
        c1 AS (SELECT w, sum(n) AS c FROM own2 GROUP BY w),
        every AS (SELECT sum(n) AS c FROM own2),
        terms AS (
            SELECT o.r, o.n, CASE
                WHEN c3.c > o.n THEN ln((c3.c - o.n) / greatest(f2.c - o.n, c3.c - o.n))
                WHEN c2.c > q.n THEN CASE WHEN o.u IS NULL THEN 0 ELSE ln(0.4) END + ln((c2.c - q.n) / greatest(f1.c - q.n, c2.c - q.n))
                ELSE CASE WHEN o.u IS NULL THEN 1 ELSE 2 END * ln(0.4) + ln(greatest(c1.c - q.n, 0.5) / greatest(every.c - q.n, 1)) END AS x
            FROM own3 o JOIN own2 q ON q.r = o.r AND q.w = o.w AND q.v IS NOT DISTINCT FROM o.v JOIN c1 ON c1.w = o.w CROSS JOIN every
            LEFT JOIN c3 ON c3.u = o.u AND c3.v = o.v AND c3.w = o.w LEFT JOIN f2 ON f2.u = o.u AND f2.v = o.v
            LEFT JOIN c2 ON c2.v = o.v AND c2.w = o.w LEFT JOIN f1 ON f1.v = o.v),
        s AS (SELECT r, sum(n * x) AS x FROM terms GROUP BY r)
        SELECT doc_id, len(ws)::BIGINT AS n_words, s.x AS log_score, s.x / len(ws) AS mean_log_score FROM t LEFT JOIN s USING (r)""",
    "op8_embedding_near_dedup": """
        WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
        l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
        e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        r AS (WITH RECURSIVE r AS (SELECT vec_id AS d, vec_id AS t FROM embeddings UNION SELECT r.d, e.y FROM r JOIN e ON e.x = r.t) SELECT d, min(t) AS least FROM r GROUP BY d)
        SELECT vec_id, (SELECT count(*) FROM e WHERE e.x = vec_id) AS n_links, least AS component_id, vec_id = least AS kept
        FROM embeddings JOIN r ON r.d = vec_id""",
}
