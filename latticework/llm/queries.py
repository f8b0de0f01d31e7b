"""Queries of the training-data operators and their SQL, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm import leakage, neighbors, pairs, pieces, spans, survivors, tokens
from latticework.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Tasks whose answer is no usable answer, with the kind of defect."""
    return pairs.defective_pairs(table(spark, d, "qa_task", "task_id", "query", "answer"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The record each field of an entity with several records is taken from."""
    return survivors.winners_long(table(spark, d, "entity"))


def p2_survivors(spark: SparkSession, d: str) -> DataFrame:
    """The surviving record of every named entity."""
    return survivors.survivors(table(spark, d, "entity"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Items over 1,200 characters, and whether they can be cut at boundaries."""
    return pieces.oversized_items(pieces.split_items(table(spark, d, "chart_entry", "ori_id", "context")))


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of those items, each page once."""
    return pieces.split_items(pieces.once_per_page(table(spark, d, "chart_entry", "ori_id", "context")))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entity", "record_id", F.col("attributes.embedding").alias("vector"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of records with a similarity of at least 0.9 of which one is among the 5 most similar of the other."""
    return neighbors.close_pairs(_vectors(spark, d))


def p5_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The 5 most similar records of every record whose id is divisible by 100, among all records, exactly."""
    found = neighbors.nearest(_vectors(spark, d), queries=F.col("record_id") % 100 == 0)
    return found.select("query", "other", "rank")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode_corpus(table(spark, d, "documents", "doc_id", "text"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the evaluation items they leak."""
    return leakage.find_leaks(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_item", "item_id", "text")).select("doc_id", "item_id")


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    """Ids of the documents without a leak."""
    docs = table(spark, d, "documents", "doc_id", "text")
    return leakage.clean(docs.select("doc_id"), leakage.find_leaks(docs, table(spark, d, "eval_item", "item_id", "text")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents with a common stretch of at least 360 characters."""
    return spans.sharing_pairs(spans.find_shared(table(spark, d, "documents", "doc_id", "text")))


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    """Shared stretches of every document, and the share of its text they cover."""
    return spans.shared_report(table(spark, d, "documents", "doc_id", "text"))


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_survivors": p2_survivors,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p5_found": p5_found,
    "p5_nearest": p5_nearest,
    "p6_ids": p6_ids,
    "p7_clean": p7_clean,
    "p7_found": p7_found,
    "p8_found": p8_found,
    "p8_spans": p8_spans,
}

_LEAKS = r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, '[\x{ad}\x{200b}-\x{200f}\x{2060}-\x{206f}\x{feff}]', '', 'g')), '[\p{L}\p{N}]+') AS w FROM documents),
        e AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_item),
        dg AS (SELECT doc_id, array_to_string(w[i : i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d)),
        eg AS (SELECT item_id, array_to_string(w[i : i + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM e))
        SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g)"""

SQL = {
    "p2_found": r"""
        WITH r AS (SELECT DISTINCT record_id, updated_at, attributes.description AS d, attributes.confidence AS c, source,
                   regexp_replace(strip_accents(lower(translate(name, 'ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ０１２３４５６７８９',
                       'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789'))), '[^\p{L}\p{N}]', '', 'g') AS k FROM entity WHERE name IS NOT NULL),
        g AS (SELECT *, min(record_id) OVER (PARTITION BY k) AS group_id, max(record_id) OVER (PARTITION BY k) AS top,
              len(list_distinct(list_filter(list_transform(source, lambda x: trim(x)), lambda x: x IS NOT NULL AND x <> ''))) AS n_ids,
              regexp_replace(d, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS t FROM r WHERE k <> ''),
        h AS (SELECT *, t IS NOT NULL AND regexp_matches(t, '[.!?][”")]*$') AND NOT regexp_matches(t, '\.\.[”")]*$')
              AND regexp_matches(t, '[A-Za-z]') AND lower(t) NOT IN ('unknown.') AND NOT regexp_matches(lower(t),
              '^(no description|the source text does not|nothing is said|there is no description|description not provided)|description pending|no details extracted') AS fine
              FROM g WHERE group_id < top)
        SELECT group_id, 'description' AS field, record_id FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY updated_at DESC NULLS LAST, record_id) AS n FROM h WHERE fine) WHERE n = 1
        UNION ALL SELECT group_id, 'confidence', record_id FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY c DESC, updated_at DESC NULLS LAST, record_id) AS n FROM h WHERE c BETWEEN 0 AND 1 AND NOT isnan(c)) WHERE n = 1
        UNION ALL SELECT group_id, 'source', record_id FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n_ids DESC, updated_at DESC NULLS LAST, record_id) AS n FROM h WHERE n_ids > 0) WHERE n = 1""",
    "p5_found": """
        WITH v AS (SELECT record_id, any_value(e) AS e FROM (SELECT record_id, CAST(attributes.embedding AS DOUBLE[]) AS e FROM entity)
                   WHERE len(e) = 64 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
                   GROUP BY record_id),
        s AS (SELECT a.record_id AS a, b.record_id AS b, round(list_cosine_similarity(a.e, b.e), 7) AS sim FROM v a JOIN v b ON a.record_id <> b.record_id)
        SELECT DISTINCT least(a, b) AS rec_a, greatest(a, b) AS rec_b
        FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS r FROM s WHERE sim >= 0.9) WHERE r <= 5""",
    "p5_nearest": """
        WITH v AS (SELECT record_id, any_value(e) AS e FROM (SELECT record_id, CAST(attributes.embedding AS DOUBLE[]) AS e FROM entity)
                   WHERE len(e) = 64 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
                   GROUP BY record_id),
        s AS (SELECT a.record_id AS query, b.record_id AS other, round(list_cosine_similarity(a.e, b.e), 7) AS sim
              FROM v a JOIN v b ON a.record_id <> b.record_id WHERE a.record_id % 100 = 0)
        SELECT query, other, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY sim DESC, other) AS INTEGER) AS rank FROM s)
        WHERE rank <= 5""",
    "p7_found": _LEAKS,
    "p7_clean": _LEAKS.replace("SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g)", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM dg JOIN eg USING (g))"),
    "p8_found": """
        WITH w AS (SELECT DISTINCT doc_id, hash(substring(text, CAST(i AS INTEGER), 360)) AS h
                   FROM (SELECT doc_id, text, unnest(range(1, length(text) - 358)) AS i FROM documents WHERE length(text) >= 360))
        SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM w a JOIN w b ON a.h = b.h AND a.doc_id < b.doc_id""",
    "p4_found": r"""
        WITH pages AS (SELECT DISTINCT ori_id, context FROM chart_entry),
        items AS (SELECT ori_id, unnest(context) AS item, unnest(range(len(context))) AS item_no FROM pages)
        SELECT ori_id, CAST(item_no AS BIGINT) AS item_no,
               CASE WHEN list_max(list_transform(regexp_split_to_array(item, '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}.!?。！？]'), lambda x: length(x))) > 1200
                    THEN 'forced' ELSE 'natural' END AS cut
        FROM items WHERE length(item) > 1200""",
}
