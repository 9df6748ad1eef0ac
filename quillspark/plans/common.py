"""Frames that several queries start from, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources.tables import table


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct documents behind the search results."""
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return table(spark, folder, "search_results").where("content IS NOT NULL").select("doc_id", "content", "page_number", blank("chapter_title"), blank("section_title"), "collection").distinct()


CHUNKS = "chunks AS (SELECT DISTINCT doc_id, content, page_number, coalesce(chapter_title, '') AS chapter_title, coalesce(section_title, '') AS section_title, collection FROM search_results WHERE content IS NOT NULL)"


def asked(spark: SparkSession, folder: str) -> DataFrame:
    """The stated query set: every logged question whose number is divisible by 100."""
    log = table(spark, folder, "query_log").where("question IS NOT NULL")
    return log.where(F.regexp_extract("query_id", "([0-9]+)$", 1).cast("long") % 100 == 0).select("query_id", "question").distinct()


ASKED = "asked AS (SELECT DISTINCT query_id, question FROM query_log WHERE question IS NOT NULL AND CAST(regexp_extract(query_id, '([0-9]+)$', 1) AS BIGINT) % 100 = 0)"


def question_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct hits with the question that was asked; nulls of texts as blanks, of scores as 0."""
    log = table(spark, folder, "query_log").where("question IS NOT NULL").select("query_id", "question").distinct()
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    hits = table(spark, folder, "search_results").select("hit_id", "query_id", "doc_id", "hit_rank", blank("content"), blank("chapter_title"), blank("section_title"), F.coalesce("score", F.lit(0.0)).alias("score"), "source", "page_number").distinct()
    return hits.join(log, "query_id")


QUESTION_HITS = """log AS (SELECT DISTINCT query_id, question FROM query_log WHERE question IS NOT NULL),
    hits AS (SELECT DISTINCT hit_id, query_id, doc_id, hit_rank, coalesce(content, '') AS content, coalesce(chapter_title, '') AS chapter_title, coalesce(section_title, '') AS section_title,
             coalesce(score, 0.0) AS score, source, page_number FROM search_results),
    qh AS (SELECT hits.*, question FROM hits JOIN log USING (query_id))"""
