"""The registered queries of this subpackage, op<N>_<name> for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import nearest
from .chat import maximal_conversations
from .common import table
from .decontamination import contamination
from .html_extraction import extract
from .language_id import identify
from .line_dedup import dedup_lines
from .mixing import mix
from .near_dedup import near_duplicates
from .quality import quality
from .toxicity import toxicity


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.selectExpr("doc_id", "n_lines", "n_removed", "char_length(text) n_chars_left", "sha2(text, 256) text_sha256")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "source_block", "release", "deadline", "slot", "mix_pos")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), percent=85)
    return found.selectExpr("doc_id", "cast(n_shingles as bigint) n_shingles", "component_id", "coalesce(doc_id = component_id, true) kept")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maximal_conversations(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op2_nearest_neighbours, op3_quality_classifier, op4_benchmark_decontamination, op5_line_dedup, op6_source_mixing, op7_language_id, op8_html_extraction, op9_minhash_near_dedup, op10_chat_formatting)}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op4_benchmark_decontamination": rf"""
        WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, least(len(w), 8) AS l, array_to_string(w[i:i + least(len(w), 8) - 1], ' ') AS g FROM b, unnest(range(1, len(w) - least(len(w), 8) + 2)) t(i) WHERE len(w) > 0),
        lens AS (SELECT DISTINCT l FROM win),
        grams AS (SELECT doc_id, i, l, array_to_string(w[i:i + l - 1], ' ') AS g FROM d, lens, unnest(range(1, len(w) - l + 2)) t(i)),
        hit AS (SELECT DISTINCT doc_id, i, l, item_id FROM grams JOIN win USING (l, g)),
        pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hit) GROUP BY doc_id),
        its AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ks FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM hit) GROUP BY doc_id)
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
            sha256(coalesce(ks, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
        FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op9_minhash_near_dedup": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g FROM d, unnest(range(1, len(w) - least(len(w), 5) + 2)) t(i) WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
        e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
        l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
        r(doc_id, m) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.b, r.m FROM r JOIN l ON r.doc_id = l.a)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.m, d.doc_id) AS component_id, coalesce(c.m, d.doc_id) = d.doc_id AS kept
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(m) AS m FROM r GROUP BY doc_id) c USING (doc_id)""",
    "op10_chat_formatting": """
        WITH c AS (SELECT conv_id, count(*) AS n, list({'r': role, 't': text} ORDER BY turn) AS l,
            string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>', chr(10) ORDER BY turn) AS rendered FROM conversations GROUP BY conv_id),
        k AS (SELECT *, min(conv_id) OVER (PARTITION BY l) AS rep_id,
            EXISTS (SELECT 1 FROM c b WHERE b.l[1] = c.l[1] AND b.n > c.n AND b.l[1:c.n] = c.l) AS begun FROM c)
        SELECT conv_id, n::BIGINT AS n_turns, rep_id = conv_id AND NOT begun AS kept, rep_id,
            CASE WHEN rep_id = conv_id AND NOT begun THEN rendered END AS rendered FROM k""",
}
