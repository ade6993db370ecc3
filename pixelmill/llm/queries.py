"""The queries ``opN_<name>`` of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, cut
from .exact_dups import exact_duplicates
from .hard_negatives import hard_negatives
from .line_dups import dropped_lines
from .mixing import mixture
from .near_dups import near_duplicates
from .packing import best_fit_packing
from .substring_dups import without_repeats
from .token_files import token_files
from .toxicity import toxicity
from .unit_dups import CLAUSE_ENDS, LEAST_WORDS, UNSPACED, passage_report
from .url_filter import url_verdicts
from .vector_search import nearest
from .whitening import whitened


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge cases: those of ``url_filter``."""
    return url_verdicts(_table(spark, sf_dir, "pages"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge cases: those of ``substring_dups``."""
    return without_repeats(_table(spark, sf_dir, "documents"), length=200)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that go, by document; documents without such lines have an empty list. Edge cases: those of ``line_dups``."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scratch = Scratch(spark)
    gone = cut(dropped_lines(docs, scratch)).select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), F.array_sort("gone").alias("gone"))
    scratch.drop()
    ids = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.array_size(F.split("text", "\n")).cast("long").alias("n_lines"))
    joined = ids.join(gone, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")), "left")
    return joined.select("doc_id", F.coalesce("n_lines", F.lit(0).cast("long")).alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce(F.array_join(F.col("gone").cast("array<string>"), ","), F.lit("")).alias("dropped"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge cases: those of ``unit_dups``."""
    return passage_report(_table(spark, sf_dir, "documents"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge cases: those of ``near_dups``."""
    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the rows, by a hash of their id, plays the batch that meets the snapshot of the others.

    Edge cases: those of ``exact_dups``.
    """
    return exact_duplicates(_table(spark, sf_dir, "documents"), is_new=F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0)


def op7_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge cases: those of ``vector_search``."""
    return nearest(_table(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 20 == 0, k=20)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge cases: those of ``packing``."""
    import public_tokenizers

    return best_fit_packing(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge cases: those of ``mixing``."""
    return mixture(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge cases: those of ``toxicity``."""
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("passages")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge cases: those of ``hard_negatives``. A seventh of the labels moves on by one first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", moved), is_anchor=F.col("vec_id") % 100 == 0)


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge cases: those of ``token_files``."""
    import public_tokenizers

    return token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge cases: those of ``whitening``."""
    return whitened(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_suffix_array_dedup, op3_line_dedup, op4_substring_dedup, op5_minhash_near_dedup, op6_exact_dedup, op7_vector_search, op8_best_fit_packing, op9_source_mixing, op10_toxicity, op11_hard_negatives, op12_token_files, op13_embedding_whitening)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


ORACLE_SQL: dict[str, str] = {
    "op4_substring_dedup": f"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
        placed AS (
            SELECT doc_id, k, line, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS BIGINT) - length(line) - 1 AS head FROM lines),
        parts AS (
            SELECT doc_id, k, head, unnest(regexp_extract_all(line, '[^{CLAUSE_ENDS}]+[{CLAUSE_ENDS}]*|[{CLAUSE_ENDS}]+')) AS part,
                   generate_subscripts(regexp_extract_all(line, '[^{CLAUSE_ENDS}]+[{CLAUSE_ENDS}]*|[{CLAUSE_ENDS}]+'), 1) AS j
            FROM placed),
        cut AS (
            SELECT doc_id, k, j, part, head + CAST(sum(length(part)) OVER (PARTITION BY doc_id, k ORDER BY j ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop,
                   trim(regexp_replace(translate(part, '{_UPPER}', '{_LOWER}'), '[ \\t\\r\\f\\v]+', ' ', 'g'), ' {CLAUSE_ENDS}') AS unit
            FROM parts),
        units AS (
            SELECT doc_id, stop - length(part) AS start, stop, unit, row_number() OVER (PARTITION BY doc_id ORDER BY k, j) AS place,
                   greatest(length(unit) - length(replace(unit, ' ', '')) + 1, length(unit) - length(replace(unit, ' ', '')) + len(regexp_extract_all(unit, '{UNSPACED.pattern}'))) AS words
            FROM cut WHERE unit <> ''),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY doc_id NULLS LAST, start) > 1 AS gone FROM units),
        runs AS (SELECT *, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS run FROM ranked WHERE gone),
        spans AS (SELECT doc_id, min(start) AS start, max(stop) AS stop FROM runs GROUP BY doc_id, run HAVING sum(words) >= {LEAST_WORDS}),
        per AS (SELECT doc_id, count(*) AS n_removed, CAST(sum(stop - start) AS BIGINT) AS chars, string_agg(start || '-' || stop, ',' ORDER BY start) AS removed FROM spans GROUP BY doc_id),
        counted AS (SELECT doc_id, count(*) AS n_units FROM units GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_removed, 0) AS n_removed, coalesce(chars, 0) AS removed_chars, coalesce(removed, '') AS removed
        FROM documents d LEFT JOIN per ON d.doc_id IS NOT DISTINCT FROM per.doc_id LEFT JOIN counted c ON d.doc_id IS NOT DISTINCT FROM c.doc_id
    """,
    "op6_exact_dedup": f"""
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS body FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY body)
    """,
    "op9_source_mixing": """
        WITH sizes AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
                   md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS shuffled
            FROM documents),
        per AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_rank
            FROM sizes GROUP BY source),
        weighed AS (
            SELECT *, CASE source_rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS most FROM per),
        levels AS (
            SELECT *, (sum(source_size) OVER () * CAST(1.5 AS DOUBLE) - (sum(most) OVER o - most))
                      / CAST(sum(weight) OVER () - (sum(weight) OVER o - weight) AS DOUBLE) AS level,
                   CAST(most AS DOUBLE) / CAST(weight AS DOUBLE) AS ratio
            FROM weighed WINDOW o AS (ORDER BY CAST(most AS DOUBLE) / CAST(weight AS DOUBLE), source_rank)),
        targets AS (
            SELECT source, source_size, source_rank,
                   coalesce(least((SELECT max(level) FROM levels WHERE level <= ratio) * weight, CAST(most AS DOUBLE)), CAST(most AS DOUBLE)) AS target
            FROM levels),
        copies AS (
            SELECT s.doc_id, s.size, t.source_size, t.target, t.source_rank, shuffled, copy,
                   sum(s.size) OVER (PARTITION BY s.source, copy ORDER BY shuffled, doc_id, size ROWS UNBOUNDED PRECEDING) + (copy - 1) * t.source_size AS stop
            FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source, (VALUES (1), (2)) AS c (copy)),
        timed AS (
            SELECT *, CASE WHEN target > 0 THEN CAST(stop AS DOUBLE) / target ELSE 0 END AS finish FROM copies),
        mixed AS (
            SELECT *, sum(size) OVER (ORDER BY finish, source_rank, shuffled, copy, doc_id ROWS UNBOUNDED PRECEDING) - size AS before FROM timed)
        SELECT doc_id, size, source_size, target,
               CAST(sum(greatest(0, least(size, (SELECT floor(sum(source_size) * CAST(1.5 AS DOUBLE) + 0.5) FROM per) - before))) AS BIGINT) AS taken
        FROM mixed GROUP BY ALL
    """,
    "op11_hard_negatives": """
        WITH t AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(c AS DOUBLE)) FOR c IN embedding] AS x
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([c FOR c IN embedding IF c IS NOT NULL AND isfinite(c)]) = len(embedding)),
        scores AS (
            SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
            FROM t a JOIN t b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        positives AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k
            FROM scores WHERE same),
        ranked AS (
            SELECT p.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
                   CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
            FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id
            WHERE k <= 5 AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
    """,
}
