"""Retrieval evaluation: metrics at k, summaries, breakdowns, coverage, and the making of evaluation sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.operators import best
from quillspark.operators import evaluation as E
from quillspark.plans.common import CHUNKS, chunks
from quillspark.sources.tables import table


def _results(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct evaluation rows (maps hold no order and take no part in that)."""
    return table(spark, folder, "eval_results").drop("recall_at_k", "precision_at_k", "f1_at_k", "hit_rate_at_k").distinct()


_RESULTS = "res AS (SELECT DISTINCT * EXCLUDE (recall_at_k, precision_at_k, f1_at_k, hit_rate_at_k) FROM eval_results)"
_METRICS = """ks AS (SELECT unnest([3, 5, 10]) AS k),
    e AS (SELECT *, list_distinct(coalesce(expected_chunk_ids, [])) AS wanted FROM res),
    f AS (SELECT e.*, k, len(list_intersect(wanted, coalesce(retrieved_chunk_ids, [])[1:k])) AS found FROM e, ks),
    m0 AS (SELECT question_id, method, success, k, found, CASE WHEN len(wanted) > 0 THEN found::DOUBLE / len(wanted) ELSE 0.0 END AS recall, found::DOUBLE / k AS precision FROM f),
    m AS (SELECT question_id, method, success, k, recall, precision, CASE WHEN recall + precision > 0 THEN 2 * recall * precision / (recall + precision) ELSE 0.0 END AS f1, CASE WHEN found > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit_rate FROM m0)"""


def recall_at_k(spark: SparkSession, folder: str) -> DataFrame:
    rows = E.metrics(_results(spark, folder))
    return rows.select("question_id", "method", "success", "k", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "f1", "hit_rate")])


def metric_summary(spark: SparkSession, folder: str) -> DataFrame:
    return E.summary(E.metrics(_results(spark, folder)).where("success"), ["method", "k"], ["recall", "precision", "f1", "hit_rate"])


def latency_summary(spark: SparkSession, folder: str) -> DataFrame:
    return E.summary(_results(spark, folder).where("success"), ["method"], ["retrieval_time"])


def success_rate(spark: SparkSession, folder: str) -> DataFrame:
    return _results(spark, folder).groupBy("method").agg(F.count("*").alias("runs"), F.count_if("success").alias("succeeded"), F.round(F.avg(F.col("success").cast("double")), 6).alias("rate"), F.countDistinct("error_message").alias("errors"))


def _question_kinds(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "questions").groupBy(F.col("id").alias("question_id")).agg(F.min("difficulty").alias("difficulty"), F.min("question_type").alias("question_type"))


def metric_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    """Mean recall and hit rate at 5 by difficulty, by type, and over all, in one pass of grouping sets."""
    rows = E.metrics(_results(spark, folder), (5,)).where("success").join(_question_kinds(spark, folder), "question_id")
    rows = rows.withColumn("difficulty", F.coalesce("difficulty", F.lit("?"))).withColumn("question_type", F.coalesce("question_type", F.lit("?")))
    out = rows.groupingSets([[F.col("difficulty")], [F.col("question_type")], []], F.col("difficulty"), F.col("question_type")).agg(F.count("*").alias("n"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("hit_rate"), 6).alias("hit_rate"))
    return out


def mean_reciprocal_rank(spark: SparkSession, folder: str) -> DataFrame:
    rank = E.first_hit_rank(F.col("expected_chunk_ids"), F.col("retrieved_chunk_ids"))
    rows = _results(spark, folder).where("success").withColumn("first_hit", rank)
    return rows.groupBy("method").agg(F.round(F.avg(F.coalesce(1 / F.col("first_hit"), F.lit(0.0))), 6).alias("mrr"), F.count("first_hit").alias("with_hit"), F.count("*").alias("n"))


def method_difference(spark: SparkSession, folder: str) -> DataFrame:
    """Questions on which the two methods differ in recall at 5."""
    rows = E.metrics(_results(spark, folder), (5,)).where("success").groupBy("question_id").agg(F.round(F.max("recall"), 6).alias("best"), F.round(F.min("recall"), 6).alias("worst"), F.count("*").alias("runs"))
    return rows.where("runs >= 2 AND best > worst")


def question_distributions(spark: SparkSession, folder: str) -> DataFrame:
    q = table(spark, folder, "questions").select("id", F.coalesce("question_type", F.lit("")).alias("question_type"), F.coalesce("difficulty", F.lit("")).alias("difficulty"), F.coalesce("disease_category", F.lit("")).alias("disease_category"), F.size(F.array_distinct(F.coalesce("keywords", F.array().cast("array<string>")))).alias("words")).distinct()
    long = q.select("id", "words", F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in ("question_type", "difficulty", "disease_category")])).alias("x"))
    return long.groupBy("x.dimension", "x.value").agg(F.count("*").alias("questions"), F.round(F.avg("words"), 6).alias("mean_keywords"))


def chunk_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """How often each available document is expected by a question, and those never expected."""
    used = table(spark, folder, "questions").select("id", F.explode("expected_chunk_ids").alias("doc_id")).distinct().groupBy("doc_id").agg(F.count("*").alias("questions"))
    docs = chunks(spark, folder).select("doc_id").distinct()
    return docs.join(used, "doc_id", "left").select("doc_id", F.coalesce("questions", F.lit(0)).alias("questions"))


def coverage_stats(spark: SparkSession, folder: str) -> DataFrame:
    per = chunk_coverage(spark, folder)
    return per.agg(F.count("*").alias("available"), F.count_if(F.col("questions") > 0).alias("used"), F.round(F.avg((F.col("questions") > 0).cast("double")) * 100, 6).alias("coverage_percent"), F.max("questions").alias("most_used"))


def missing_expected(spark: SparkSession, folder: str) -> DataFrame:
    """Expected ids that no document has."""
    expected = table(spark, folder, "questions").select(F.explode("expected_chunk_ids").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    return expected.join(chunks(spark, folder).select("doc_id"), "doc_id", "left_anti")


def expected_chunk_mapping(spark: SparkSession, folder: str) -> DataFrame:
    """The four best documents of each question: 2 for a keyword in the content, 3 for one in a title, ties by id.

    Documents are searched and summed up in the tasks that hold them, of which four remain for each question.
    """
    q = table(spark, folder, "questions").select(F.col("id").alias("query_id"), F.explode("keywords").alias("term")).where("length(term) >= 2")
    docs = chunks(spark, folder).select("doc_id", "content", F.concat_ws(" ", "chapter_title", "section_title").alias("titles"))
    return best.most_points(q, docs, "doc_id", {"content": 2, "titles": 3}, 4).select(F.col("query_id").alias("question_id"), F.col("id").alias("doc_id"), "points", "nth")


def _best_of_blocks(questions, met):
    """The four best documents of a block of documents for each question of a block: points of its words summed over their postings."""
    import numpy as np
    import pandas as pd

    docs, at = np.unique(met["doc_id"].to_numpy(), return_inverse=True)
    postings = {word: (at[rows], met["points"].to_numpy(np.int64)[rows]) for word, rows in met.groupby("term").indices.items()}
    out = []
    for question, asked in questions.groupby("question_id")["word"]:
        points = np.zeros(len(docs), np.int64)
        for word in asked:
            if word in postings:
                points[postings[word][0]] += postings[word][1]
        hit = np.flatnonzero(points)
        if len(hit) > 4:
            hit = hit[np.argpartition(hit - points[hit] * len(docs), 3)[:4]]
        out += [(question, docs[i], points[i]) for i in hit]
    return pd.DataFrame(out, columns=["question_id", "doc_id", "points"])


def expected_chunk_mapping_all(spark: SparkSession, folder: str) -> DataFrame:
    """The four best documents of each question by keywords and related concepts in any case: 2 for one in the content, 3 for one in a title, ties by id.

    A question without any hit gets two documents in the order of their digests, from a place that its own digest names.
    Words meet documents through their first two characters; questions meet postings in blocks, of which four documents each remain.
    """
    none = F.array().cast("array<string>")
    asked = table(spark, folder, "questions").select(F.col("id").alias("question_id"), F.explode(F.concat(F.coalesce("keywords", none), F.coalesce("related_concepts", none))).alias("word")).where("word IS NOT NULL").distinct()
    docs = chunks(spark, folder).select("doc_id", F.lower("content").alias("content"), F.lower(F.concat_ws(" ", "chapter_title", "section_title")).alias("titles"))
    words = asked.select(F.col("word").alias("term"), F.lower("word").alias("low"), F.substring(F.lower("word"), 1, 2).alias("head")).distinct()
    text = F.concat_ws("\n", "content", "titles")
    heads = F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(text, F.lit("(?s)(.)"), F.lit(1)), F.regexp_extract_all(text, F.lit("(?s)(?=(..))"), F.lit(1))))
    points = F.when(F.contains("content", F.col("low")), 2).otherwise(0) + F.when(F.contains("titles", F.col("low")), 3).otherwise(0)
    met = docs.select("doc_id", "content", "titles", F.explode(heads).alias("head")).join(F.broadcast(words), "head").select("doc_id", "term", points.alias("points")).where("points > 0").groupBy("doc_id", "term").agg(F.sum("points").alias("points"))

    doc_blocks, question_blocks = (1 + table(spark, folder, name).count() // size for name, size in (("search_results", 8192), ("questions", 4096)))
    split = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = asked.select("question_id", "word", split("question_id", question_blocks).alias("qb"), every(doc_blocks).alias("db"))
    right = met.select("doc_id", "term", "points", split("doc_id", doc_blocks).alias("db"), every(question_blocks).alias("qb"))
    scores = left.groupBy("qb", "db").cogroup(right.groupBy("qb", "db")).applyInPandas(_best_of_blocks, f"question_id string, doc_id {dict(docs.dtypes)['doc_id']}, points long")

    digest = F.md5(F.col("doc_id").cast("string"))
    ids = table(spark, folder, "search_results").where("content IS NOT NULL").select("doc_id").distinct().select("doc_id", digest.alias("digest"), F.substring(digest, 1, 3).alias("bucket"))
    counts = ids.groupBy("bucket").agg(F.count("*").alias("n"))
    starts = counts.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("start"))
    placed = ids.join(starts, "bucket").select("doc_id", (F.col("start") + F.row_number().over(Window.partitionBy("bucket").orderBy("digest", "doc_id")) - 1).alias("place"))
    first = F.conv(F.substring(F.md5("question_id"), 1, 8), 16, 10).cast("long")
    places = table(spark, folder, "questions").select(F.col("id").alias("question_id")).distinct().crossJoin(counts.agg(F.sum("n").alias("n")).where("n > 0"))
    picks = places.select("question_id", F.explode(F.array_distinct(F.array(first % F.col("n"), (first + 1) % F.col("n")))).alias("place")).join(placed, "place").select("question_id", "doc_id", F.lit(0).cast("long").alias("points"))

    of = Window.partitionBy("question_id")
    rows = scores.unionByName(picks).withColumn("most", F.max("points").over(of)).withColumn("nth", F.row_number().over(of.orderBy(F.col("points").desc(), "doc_id")).cast("long"))
    return rows.where("nth <= 4 AND (points > 0 OR most = 0)").drop("most")


def source_variety(spark: SparkSession, folder: str) -> DataFrame:
    hits = table(spark, folder, "search_results").where("query_id IS NOT NULL")
    return hits.groupBy("query_id").agg(F.countDistinct("source").alias("sources"), F.countDistinct("collection").alias("collections"), F.countDistinct("hit_id").alias("hits"), F.countDistinct("doc_id").alias("documents"))


QUERIES = {f.__name__: f for f in (recall_at_k, metric_summary, latency_summary, success_rate, metric_breakdown, mean_reciprocal_rank, method_difference, question_distributions, chunk_coverage, coverage_stats, missing_expected, expected_chunk_mapping, expected_chunk_mapping_all, source_variety)}


def _summary_sql(source: str, keys: str, columns: list[str]) -> str:
    parts = " UNION ALL ".join(f"SELECT {keys}, '{c}' AS metric, {c}::DOUBLE AS value FROM {source}" for c in columns)
    return f"SELECT {keys}, metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS least, round(max(value), 6) AS greatest, round(median(value), 6) AS median, count(value) AS n FROM ({parts}) GROUP BY ALL"


SQL = {
    "recall_at_k": f"WITH {_RESULTS}, {_METRICS} SELECT question_id, method, success, k, round(recall, 6) AS recall, round(precision, 6) AS precision, round(f1, 6) AS f1, round(hit_rate, 6) AS hit_rate FROM m",
    "metric_summary": f"WITH {_RESULTS}, {_METRICS}, ok AS (SELECT * FROM m WHERE success) {_summary_sql('ok', 'method, k', ['recall', 'precision', 'f1', 'hit_rate'])}",
    "latency_summary": f"WITH {_RESULTS}, ok AS (SELECT * FROM res WHERE success) {_summary_sql('ok', 'method', ['retrieval_time'])}",
    "success_rate": f"WITH {_RESULTS} SELECT method, count(*) AS runs, count(*) FILTER (success) AS succeeded, round(avg(success::INT::DOUBLE), 6) AS rate, count(DISTINCT error_message) AS errors FROM res GROUP BY method",
    "metric_breakdown": f"WITH {_RESULTS}, {_METRICS}, kinds AS (SELECT id AS question_id, coalesce(min(difficulty), '?') AS difficulty, coalesce(min(question_type), '?') AS question_type FROM questions GROUP BY id) SELECT difficulty, question_type, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(hit_rate), 6) AS hit_rate FROM m JOIN kinds USING (question_id) WHERE success AND k = 5 GROUP BY GROUPING SETS ((difficulty), (question_type), ())",
    "mean_reciprocal_rank": f"WITH {_RESULTS}, f AS (SELECT method, list_min(list_filter(list_transform(coalesce(retrieved_chunk_ids, []), lambda x, i: CASE WHEN list_contains(expected_chunk_ids, x) THEN i END), lambda r: r IS NOT NULL)) AS first_hit FROM res WHERE success) SELECT method, round(avg(coalesce(1.0 / first_hit, 0.0)), 6) AS mrr, count(first_hit) AS with_hit, count(*) AS n FROM f GROUP BY method",
    "method_difference": f"WITH {_RESULTS}, {_METRICS} SELECT question_id, round(max(recall), 6) AS best, round(min(recall), 6) AS worst, count(*) AS runs FROM m WHERE success AND k = 5 GROUP BY question_id HAVING count(*) >= 2 AND round(max(recall), 6) > round(min(recall), 6)",
    "question_distributions": "WITH q AS (SELECT DISTINCT id, coalesce(question_type, '') AS question_type, coalesce(difficulty, '') AS difficulty, coalesce(disease_category, '') AS disease_category, len(list_distinct(coalesce(keywords, []))) AS words FROM questions), l AS (SELECT words, 'question_type' AS dimension, question_type AS value FROM q UNION ALL SELECT words, 'difficulty', difficulty FROM q UNION ALL SELECT words, 'disease_category', disease_category FROM q) SELECT dimension, value, count(*) AS questions, round(avg(words), 6) AS mean_keywords FROM l GROUP BY ALL",
    "chunk_coverage": f"WITH {CHUNKS}, u AS (SELECT doc_id, count(*) AS questions FROM (SELECT DISTINCT id, unnest(expected_chunk_ids) AS doc_id FROM questions) GROUP BY doc_id), d AS (SELECT DISTINCT doc_id FROM chunks) SELECT doc_id, coalesce(questions, 0) AS questions FROM d LEFT JOIN u USING (doc_id)",
    "coverage_stats": f"WITH {CHUNKS}, u AS (SELECT doc_id, count(*) AS questions FROM (SELECT DISTINCT id, unnest(expected_chunk_ids) AS doc_id FROM questions) GROUP BY doc_id), d AS (SELECT DISTINCT doc_id FROM chunks), p AS (SELECT doc_id, coalesce(questions, 0) AS questions FROM d LEFT JOIN u USING (doc_id)) SELECT count(*) AS available, count(*) FILTER (questions > 0) AS used, round(avg(CASE WHEN questions > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100, 6) AS coverage_percent, max(questions) AS most_used FROM p",
    "missing_expected": f"WITH {CHUNKS}, x AS (SELECT DISTINCT doc_id FROM (SELECT unnest(expected_chunk_ids) AS doc_id FROM questions) WHERE doc_id IS NOT NULL) SELECT doc_id FROM x WHERE doc_id NOT IN (SELECT doc_id FROM chunks WHERE doc_id IS NOT NULL)",
    "expected_chunk_mapping": f"WITH {CHUNKS}, q AS (SELECT DISTINCT question_id, word FROM (SELECT id AS question_id, unnest(keywords) AS word FROM questions) WHERE length(word) >= 2), s AS (SELECT question_id, doc_id, sum(CASE WHEN contains(content, word) THEN 2 ELSE 0 END + CASE WHEN contains(chapter_title || ' ' || section_title, word) THEN 3 ELSE 0 END)::BIGINT AS points FROM q, chunks GROUP BY question_id, doc_id HAVING points > 0) SELECT question_id, doc_id, points, nth FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY points DESC, doc_id) AS nth FROM s) WHERE nth <= 4",
    "expected_chunk_mapping_all": f"""WITH {CHUNKS}, q AS (SELECT DISTINCT question_id, word FROM (SELECT id AS question_id, unnest(list_concat(coalesce(keywords, []), coalesce(related_concepts, []))) AS word FROM questions) WHERE word IS NOT NULL),
        s AS (SELECT question_id, doc_id, sum(CASE WHEN contains(lower(content), lower(word)) THEN 2 ELSE 0 END + CASE WHEN contains(lower(chapter_title || ' ' || section_title), lower(word)) THEN 3 ELSE 0 END)::BIGINT AS points FROM q, chunks GROUP BY question_id, doc_id HAVING points > 0),
        d AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT doc_id FROM chunks)),
        u AS (SELECT DISTINCT id AS question_id, ('0x' || substring(md5(id), 1, 8))::BIGINT AS first FROM questions WHERE id NOT IN (SELECT question_id FROM s)),
        p AS (SELECT question_id, doc_id, 0::BIGINT AS points FROM u JOIN d ON place = first % n OR place = (first + 1) % n)
        SELECT question_id, doc_id, points, nth FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY points DESC, doc_id) AS nth FROM (SELECT * FROM s UNION ALL SELECT * FROM p)) WHERE nth <= 4""",
    "source_variety": "SELECT query_id, count(DISTINCT source) AS sources, count(DISTINCT collection) AS collections, count(DISTINCT hit_id) AS hits, count(DISTINCT doc_id) AS documents FROM search_results WHERE query_id IS NOT NULL GROUP BY query_id",
}
