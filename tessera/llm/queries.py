"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.session import table
from tessera.llm import conversations, defects, groups, history, language, leakage, names, neighbours, packing, splitting

WHITE_SPACE_CLASS = r"[^\x{9}-\x{d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects.broken_pairs(table(spark, sf_dir, "conversation_messages"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.repeated_files(table(spark, sf_dir, "document_files"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.oversized_pieces(table(spark, sf_dir, "chunks")).filter("piece_no = 1").select("chunk_id").distinct()


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_chunks(table(spark, sf_dir, "chunks"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = names.same_names(table(spark, sf_dir, "graph_phrases"), "phrase_id", "phrase")
    return pairs.select(F.col("id_a").alias("phrase_id_a"), F.col("id_b").alias("phrase_id_b"))


def p4_fact_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spellings in facts and phrases with the group of the person or organisation they name."""
    facts = table(spark, sf_dir, "graph_facts")
    typed = facts.select(F.col("subject").alias("name")).union(facts.select("object")).union(table(spark, sf_dir, "graph_phrases").select("phrase")).filter("name is not null").distinct()
    return names.name_groups(typed.withColumn("id", F.col("name")), "id", "name").withColumnRenamed("id", "name")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.whole_conversations(table(spark, sf_dir, "conversation_messages"))


def p5_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message's place in its conversation by Kahn's algorithm, and whether it was left over."""
    return conversations.reply_order(table(spark, sf_dir, "conversation_messages")).select("conversation_id", "message_id", "pos", "cyclic")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.tied_phrases(table(spark, sf_dir, "graph_edges"), table(spark, sf_dir, "graph_phrases"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "chunks").select(F.lit("chunks").alias("vec_set"), F.col("chunk_id").alias("id"), "embedding")
    phrases = table(spark, sf_dir, "graph_phrases").select(F.lit("graph_phrases").alias("vec_set"), F.col("phrase_id").alias("id"), "embedding")
    return chunks.unionByName(phrases)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.similar_pairs(_vectors(spark, sf_dir))


def p7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 most similar others of every usable vector, without a least similarity."""
    return neighbours.nearest_vectors(_vectors(spark, sf_dir)).withColumnRenamed("vec_set", "vec_table")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(table(spark, sf_dir, "documents"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p8_containers(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.tolerant_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.mislabelled(language.language_segments(table(spark, sf_dir, "documents")))


def p10_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_segments(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p2_found": p2_found,
        "p3_found": p3_found,
        "p3_pieces": p3_pieces,
        "p4_found": p4_found,
        "p4_fact_names": p4_fact_names,
        "p5_found": p5_found,
        "p5_order": p5_order,
        "p6_found": p6_found,
        "p7_found": p7_found,
        "p7_neighbours": p7_neighbours,
        "p8_containers": p8_containers,
        "p8_fill": p8_fill,
        "p9_found": p9_found,
        "p9_overlaps": p9_overlaps,
        "p10_found": p10_found,
        "p10_segments": p10_segments,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": rf"""
            SELECT DISTINCT chunk_id FROM chunks
            WHERE len(regexp_extract_all(content, '{WHITE_SPACE_CLASS}')) > 500""",
        "p5_found": """
            WITH said AS (
                SELECT conversation_id, message_id, created_at, content,
                       CASE WHEN lower(trim(coalesce(role, ''))) IN ('user', 'human') THEN 0
                            WHEN lower(trim(coalesce(role, ''))) IN ('assistant', 'bot') THEN 2 ELSE 1 END AS speaker
                FROM conversation_messages
                WHERE conversation_id IS NOT NULL AND lower(trim(coalesce(role, ''))) NOT IN ('system', 'tool')),
            kept AS (
                SELECT conversation_id, speaker, created_at, content, min(message_id) AS message_id
                FROM said WHERE created_at IS NOT NULL GROUP BY ALL),
            placed AS (
                SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at, speaker, message_id) AS turn_no FROM kept),
            good AS (
                SELECT conversation_id FROM placed GROUP BY conversation_id
                HAVING count(*) % 2 = 0
                   AND bool_and(speaker = CASE WHEN turn_no % 2 = 1 THEN 0 ELSE 2 END)
                   AND bool_and(coalesce(regexp_matches(content, '[\\p{L}\\p{N}]'), false)))
            SELECT conversation_id, CAST(turn_no AS INTEGER) AS turn_no, message_id FROM placed
            WHERE conversation_id IN (SELECT conversation_id FROM good)
              AND conversation_id NOT IN (SELECT conversation_id FROM said WHERE created_at IS NULL)""",
        "p6_found": """
            WITH RECURSIVE tie AS (
                SELECT phrase_a AS a, phrase_b AS b FROM graph_edges
                WHERE weight >= 0.8 AND NOT isnan(weight) AND NOT isinf(weight) AND phrase_a <> phrase_b
                  AND phrase_a IN (SELECT phrase_id FROM graph_phrases)
                  AND phrase_b IN (SELECT phrase_id FROM graph_phrases)),
            both_ways AS (SELECT a, b FROM tie UNION SELECT b, a FROM tie),
            reach AS (
                SELECT a, b FROM both_ways
                UNION
                SELECT r.a, t.b FROM reach r JOIN both_ways t ON r.b = t.a)
            SELECT a AS phrase_id, least(a, min(b)) AS group_id FROM reach GROUP BY a""",
        "p7_neighbours": """
            WITH v AS (
                SELECT 'chunks' AS t, chunk_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM chunks WHERE embedding IS NOT NULL
                UNION ALL SELECT 'graph_phrases', phrase_id, CAST(embedding AS DOUBLE[]) FROM graph_phrases WHERE embedding IS NOT NULL),
            u AS (SELECT * FROM v WHERE list_dot_product(e, e) > 0),
            s AS (SELECT a.t, a.id, b.id AS other_id, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM u a JOIN u b ON a.t = b.t AND a.id <> b.id)
            SELECT t AS vec_table, id, other_id, similarity, CAST(row_number() OVER (PARTITION BY t, id ORDER BY similarity DESC, other_id) AS INTEGER) AS rank
            FROM s QUALIFY row_number() OVER (PARTITION BY t, id ORDER BY similarity DESC, other_id) <= 5""",
        "p9_found": r"""
            WITH corpus AS (
                SELECT doc_id, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+') AS w FROM documents),
            items AS (
                SELECT item_id, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+') AS w FROM eval_items),
            corpus_runs AS (
                SELECT doc_id, array_to_string(w[i : i + 12], ' ') AS run FROM corpus, unnest(range(1, len(w) - 11)) AS r(i)),
            item_runs AS (
                SELECT item_id, array_to_string(w[i : i + 12], ' ') AS run FROM items, unnest(range(1, len(w) - 11)) AS r(i))
            SELECT DISTINCT doc_id, item_id FROM corpus_runs JOIN item_runs USING (run)""",
    }
