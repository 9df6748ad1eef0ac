"""Composed searches: sums of clauses, rescored and re-sorted hits, dispatch by search type, live hybrid search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import lexicons as L
from quillspark.functions.text import any_of_sql, tokens_sql
from quillspark.operators import best, fusion, keyword, vectors
from quillspark.operators import ranking as R
from quillspark.operators.questions import search_keywords
from quillspark.plans import ranking as P
from quillspark.plans.common import ASKED, CHUNKS, asked, chunks
from quillspark.plans.retrieval import _RANK, _TERMS, TOP, _bm25_sql
from quillspark.session import broadcast_if_small, cut_lineage
from quillspark.sources.tables import table

FIELDS = ["chapter_title", "section_title", "content"]
TIE = 1e-9


def _fields(spark: SparkSession, folder: str, words_only: bool = False) -> DataFrame:
    terms = keyword.query_terms(asked(spark, folder))
    if words_only:
        terms = terms.where(F.col("term").rlike("^[a-z0-9]{2,}$"))
    return keyword.field_scores(terms, chunks(spark, folder), "doc_id", FIELDS)


def _top(scores: DataFrame, k: int = TOP) -> DataFrame:
    return keyword.top_hits(scores, k).select("query_id", F.col("id").alias("doc_id"), "score", F.col("hit_rank").alias("base_rank"))


def _best(spark: SparkSession, folder: str, combine: Callable, weight: Column | None = None) -> DataFrame:
    hits = best.best_documents(keyword.query_terms(asked(spark, folder)), chunks(spark, folder), "doc_id", FIELDS, TOP, combine, weight)
    return hits.select("query_id", F.col("id").alias("doc_id"), "score", F.col("hit_rank").alias("base_rank"))


def _with_texts(spark: SparkSession, folder: str, base: DataFrame) -> DataFrame:
    """Hits with their question and the texts of their documents; only the documents of hits are read beyond their id."""
    base = cut_lineage(base)
    docs = chunks(spark, folder).join(broadcast_if_small(base.select("doc_id").distinct()), "doc_id", "left_semi")
    return base.join(docs, "doc_id").join(asked(spark, folder), "query_id")


def should_sum(spark: SparkSession, folder: str) -> DataFrame:
    """Sum of all clauses that match: titles twelve and ten times, content three times."""
    return _best(spark, folder, best.clauses_of([(("chapter_title",), 12.0), (("section_title",), 10.0), (("content",), 3.0)]))


def constant_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Exact words and numbers: 2.5 for either title, 2 for the content, whatever the frequencies."""
    return _top(keyword.constant_scores(_fields(spark, folder, True), {"chapter_title": 2.5, "section_title": 2.5, "content": 2.0}))


def must_not_subtypes(spark: SparkSession, folder: str) -> DataFrame:
    """Hits without those that name a subtype, where the question asks for the type itself and names no subtype."""
    from quillspark.plans.common import question_hits

    plain = F.contains("question", F.lit(_TYPE)) & ~_any(F.col("question"), _SUBTYPES)
    hits = keyword.without_subtypes(question_hits(spark, folder), plain, ["content", "chapter_title", "section_title"], _SUBTYPES)
    return hits.select("hit_id", "query_id", "doc_id", "hit_rank")


_TYPE = "腺癌"
_SUBTYPES = L.SYNONYMS["腺癌"][1:]


def _any(c: Column, words: list[str]) -> Column:
    from quillspark.functions.text import any_of

    return any_of(c, words)


def _weights() -> Column:
    return keyword.filtered_weights([(F.col("section_title") != "", 2.0), (F.col("content").rlike(r"图\s*[0-9]|Fig\."), 5.0), (F.length("content") < 150, 0.3)])


def _rescored(spark: SparkSession, folder: str, clauses: list, second: bool) -> DataFrame:
    """The best of the weighted sums, with their question and texts, and the score that the ranking rules combine."""
    rows = _with_texts(spark, folder, _best(spark, folder, best.clauses_of(clauses), _weights()))
    q, chapter, section, content, titles = P._columns()
    if second:
        _, confidence, _ = R.description(content, titles)
        final = R.tiered(F.col("score"), R.title_priority_exact(q, chapter, section), confidence, R.term_density(q, content), R.SECOND_TIERS, (8.0, 2.0))
    else:
        _, confidence = R.content_class(content, titles)
        _, relevance = R.concept_relevance(q, content)
        final = R.tiered(F.col("score"), R.title_priority(q, chapter, section), confidence, relevance, R.FIRST_TIERS, (5.0, 0.5))
    return rows.select("query_id", "doc_id", "base_rank", F.round(final + TIE, 4).alias("score"))


def _resorted(rows: DataFrame) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "base_rank")
    return rows.withColumn("hit_rank", F.row_number().over(best).cast("long"))


FIRST_CLAUSES = [(("chapter_title", "section_title"), 25.0), (("content",), 3.0), (("chapter_title",), 20.0)]
SECOND_CLAUSES = [(("chapter_title", "section_title"), 60.0), (("content",), 2.0), (("chapter_title",), 75.0)]


def keyword_search_v1(spark: SparkSession, folder: str) -> DataFrame:
    """First keyword search: best title, content and chapter clauses, filter weights, top ten, rescored by the first rules and re-sorted."""
    return _resorted(_rescored(spark, folder, FIRST_CLAUSES, False))


def keyword_search_v2(spark: SparkSession, folder: str) -> DataFrame:
    """Second keyword search: higher title boosts, rescored by the second rules and re-sorted."""
    return _resorted(_rescored(spark, folder, SECOND_CLAUSES, True))


def keyword_search_v3(spark: SparkSession, folder: str) -> DataFrame:
    """Third keyword search: all words (5), words (3), exact words in titles and content (2.5, 2); rescored 0.7 / 0.2 / 0.1, order kept."""

    def combine(found, needed):
        content = found["content"]
        total = content.score * 5.0 * (content.matched == needed) + content.score * 3.0
        for field, constant in {"chapter_title": 2.5, "section_title": 2.5, "content": 2.0}.items():
            total = total + constant * found[field].any_term("[a-z0-9]{2,}")
        return total

    rows = _with_texts(spark, folder, _best(spark, folder, combine))
    q, chapter, section, content, titles = P._columns()
    _, confidence, _ = R.description(content, titles)
    final = F.col("score") * 0.7 + confidence * 0.2 + R.term_density(q, content) * 0.1
    return rows.select("query_id", "doc_id", "base_rank", F.round(final + TIE, 4).alias("score"))


def title_search(spark: SparkSession, folder: str) -> DataFrame:
    """Contents with a keyword of the stated questions in a heading (3 and 2) or as a phrase (2.5), and its term score; the best ten a keyword."""
    stated = table(spark, folder, "questions").where(F.regexp_extract("id", "([0-9]+)$", 1).cast("long") % 100 == 0)
    asked_for = stated.select(F.explode("keywords").alias("question")).where("question IS NOT NULL AND question != ''").distinct().select(F.col("question").alias("query_id"), "question")
    docs = chunks(spark, folder)
    scores = keyword.bm25_scores(keyword.query_terms(asked_for), docs, "doc_id", "content").select("query_id", F.col("id").alias("doc_id"), "score")
    rows = scores.join(docs.select("doc_id", "content"), "doc_id")
    has = lambda prefix: F.contains("content", F.concat(F.lit(prefix), F.col("query_id")))
    total = F.col("score") + F.when(has("# "), 3.0).otherwise(0.0) + F.when(has("## "), 2.0).otherwise(0.0) + F.when(has(""), 2.5).otherwise(0.0)
    return _top(rows.select("query_id", F.col("doc_id").alias("id"), total.alias("score")))


def search_dispatch(spark: SparkSession, folder: str) -> DataFrame:
    """Every stated question by its own search type and size: keyword, semantic, both merged (hybrid, intelligent); other types find nothing."""
    log = table(spark, folder, "query_log").where("question IS NOT NULL AND search_type IS NOT NULL AND top_k IS NOT NULL")
    log = log.where(F.regexp_extract("query_id", "([0-9]+)$", 1).cast("long") % 100 == 0).select("query_id", "search_type", "top_k").distinct()
    hits = table(spark, folder, "search_results").where("query_id IS NOT NULL AND doc_id IS NOT NULL").join(log.select("query_id").distinct(), "query_id", "left_semi")
    first, second = fusion.side(hits, "elasticsearch"), fusion.side(hits, "milvus")
    merged = fusion.weighted_merge(first, second, 0.5).select("query_id", "id", "score")
    kinds = {"keyword": first.select("query_id", "id", F.col("score").alias("score")), "semantic": second.select("query_id", "id", F.col("score").alias("score")), "hybrid": merged, "intelligent": merged}
    rows = None
    for kind, found in kinds.items():
        part = log.where(F.col("search_type") == kind).join(found, "query_id")
        rows = part if rows is None else rows.unionByName(part)
    best = Window.partitionBy("query_id", "search_type", "top_k").orderBy(F.col("score").desc(), "id")
    ranked = rows.withColumn("score", F.round("score", 6)).withColumn("hit_rank", F.row_number().over(best).cast("long")).where("hit_rank <= top_k")
    return ranked.select("query_id", "search_type", F.col("id").alias("doc_id"), "score", "hit_rank")


def _stated_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Questions with a vector of their own: titles of the documents whose number is divisible by 100."""
    docs = table(spark, folder, "documents").where("doc_id % 100 = 0 AND title IS NOT NULL AND title != ''")
    return docs.select(F.col("doc_id").alias("query_id"), F.col("title").alias("question"))


def _keyword_side(spark: SparkSession, folder: str, question: Column, k: int) -> DataFrame:
    texts = table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", "text")
    terms = keyword.query_terms(_stated_documents(spark, folder).select("query_id", question.alias("question")))
    return best.best_documents(terms, texts, "doc_id", ["text"], k)


def _vector_side(spark: SparkSession, folder: str, k: int) -> DataFrame:
    v = table(spark, folder, "embeddings").select("vec_id", "embedding")
    stated = v.join(_stated_documents(spark, folder).select(F.col("query_id").alias("vec_id")), "vec_id", "left_semi")
    hits = vectors.exact_topk(v, stated, k, "l2")
    return hits.select(F.col("query_vec").alias("query_id"), F.col("vec_id").alias("id"), F.round(1 / (1 + F.col("distance")), 6).alias("score"), "hit_rank")


def hybrid_search_v1(spark: SparkSession, folder: str) -> DataFrame:
    """Keyword and vector search of the same question, ten hits each, merged half and half, the best ten."""
    merged = fusion.weighted_merge(_keyword_side(spark, folder, F.col("question"), TOP), _vector_side(spark, folder, TOP), 0.5)
    return fusion.ranked(merged, TOP).select("query_id", F.col("id").alias("doc_id"), "score", "found_by", "hit_rank")


def hybrid_search_v2(spark: SparkSession, folder: str) -> DataFrame:
    """Keyword search of the extracted keywords and vector search of the question, twenty hits each, merged six to four, the best ten."""
    merged = fusion.weighted_merge(_keyword_side(spark, folder, search_keywords(F.col("question")), 2 * TOP), _vector_side(spark, folder, 2 * TOP), 0.6)
    return fusion.ranked(merged, TOP).select("query_id", F.col("id").alias("doc_id"), "score", "found_by", "hit_rank")


def semantic_search_v2(spark: SparkSession, folder: str) -> DataFrame:
    """Vector hits with 0.7 of their similarity, 0.2 of the confidence and 0.1 of the term density of the text; the order stays that of the distance."""
    docs = table(spark, folder, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), "text", F.coalesce("title", F.lit("")).alias("title"))
    rows = _vector_side(spark, folder, TOP).join(docs, "id").join(_stated_documents(spark, folder), "query_id")
    _, confidence, _ = R.description(F.col("text"), F.col("title"))
    final = F.col("score") * 0.7 + confidence * 0.2 + R.term_density(F.col("question"), F.col("text")) * 0.1
    return rows.select("query_id", F.col("id").alias("doc_id"), F.col("hit_rank").alias("base_rank"), F.round(final + TIE, 4).alias("score"))


def distance_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """Fusion of normalised scores where the vector side is a distance: the score over its best, and one minus the distance over its range."""
    first, second = _keyword_side(spark, folder, F.col("question"), 2 * TOP), _vector_side(spark, folder, 2 * TOP)
    w = Window.partitionBy("query_id")
    a = first.select("query_id", "id", F.when(F.max("score").over(w) > 0, F.col("score") / F.max("score").over(w)).otherwise(0.0).alias("a"))
    d = second.withColumn("distance", 1 / F.col("score") - 1)
    low, high = F.min("distance").over(w), F.max("distance").over(w)
    b = d.select("query_id", "id", F.when(high > low, 1 - (F.col("distance") - low) / (high - low)).otherwise(1.0).alias("b"))
    rows = a.join(b, ["query_id", "id"], "full")
    score = F.round(0.6 * F.coalesce("a", F.lit(0.0)) + 0.4 * F.coalesce("b", F.lit(0.0)), 6)
    return fusion.ranked(rows.select("query_id", "id", score.alias("score")), TOP).select("query_id", F.col("id").alias("doc_id"), "score", "hit_rank")


QUERIES = {f.__name__: f for f in (should_sum, constant_terms, must_not_subtypes, keyword_search_v1, keyword_search_v2, keyword_search_v3, title_search, search_dispatch, hybrid_search_v1, hybrid_search_v2, semantic_search_v2, distance_fusion)}

_PARTS = ", ".join(_bm25_sql(f, "chunks", "doc_id", f"f{i}") for i, f in enumerate(FIELDS))
_ALL = "ff AS (SELECT query_id, id, score AS chapter, NULL::DOUBLE AS section, NULL::DOUBLE AS content FROM f0 UNION ALL SELECT query_id, id, NULL, score, NULL FROM f1 UNION ALL SELECT query_id, id, NULL, NULL, score FROM f2), g AS (SELECT query_id, id, max(chapter) AS chapter, max(section) AS section, max(content) AS content FROM ff GROUP BY query_id, id)"
_BASE = "SELECT query_id, id AS doc_id, score, base_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS base_rank FROM r) WHERE base_rank <= 10"
_WEIGHT = "(CASE WHEN section_title <> '' THEN 2.0 ELSE 1.0 END) * (CASE WHEN regexp_matches(content, '图\\s*[0-9]|Fig\\.') THEN 5.0 ELSE 1.0 END) * (CASE WHEN length(content) < 150 THEN 0.3 ELSE 1.0 END)"
_WORDS = f"t0 AS (SELECT DISTINCT query_id, unnest({tokens_sql('question')}) AS term FROM asked), terms AS (SELECT * FROM t0 WHERE regexp_full_match(term, '[a-z0-9]{{2,}}'))"
_BEST2 = "greatest(coalesce(chapter, 0.0), coalesce(section, 0.0))"


def _rescored_sql(title_boost: float, content_boost: float, chapter_boost: float, second: bool) -> str:
    score = f"round(({title_boost}::DOUBLE * {_BEST2} + {content_boost}::DOUBLE * coalesce(g.content, 0.0) + {chapter_boost}::DOUBLE * coalesce(chapter, 0.0)) * {_WEIGHT.replace('content', 'c.content').replace('section_title', 'c.section_title')}, 6)"
    extra = P._DMF if second else P._COUNTS
    title, confidence, relevance = (P._TITLE2, P._F2, P._DENSITY) if second else (P._TITLE1, P._F1, P._QR)
    tiers = P._tiers_sql(R.SECOND_TIERS, (8.0, 2.0)) if second else P._tiers_sql(R.FIRST_TIERS, (5.0, 0.5))
    return f"""WITH {CHUNKS}, {ASKED}, {_TERMS}, {_PARTS}, {_ALL},
        r AS (SELECT query_id, id, {score} AS score FROM g JOIN chunks c ON g.id = c.doc_id), b AS ({_BASE}),
        x AS (SELECT b.*, question, c.content, c.chapter_title, c.section_title, {extra} FROM b JOIN chunks c USING (doc_id) JOIN asked USING (query_id)),
        y AS (SELECT query_id, doc_id, base_rank, score, {title} AS ts, {confidence} AS cf, {relevance} AS rl FROM x),
        z AS (SELECT query_id, doc_id, base_rank, round({tiers} + 1e-9::DOUBLE, 4) AS score FROM y)
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, base_rank) AS hit_rank FROM z"""


_STATED = "stated AS (SELECT doc_id AS query_id, title AS question FROM documents WHERE doc_id % 100 = 0 AND title IS NOT NULL AND title <> '')"
_SDOCS = "(SELECT doc_id, text FROM documents WHERE text IS NOT NULL)"
_KEYWORDS = r"""CASE WHEN array_to_string({found}, ' ') <> '' THEN array_to_string({found}, ' ') ELSE {cut} END"""


def _side_sql(k: int, extracted: bool) -> str:
    from quillspark.functions.text import contained_sql
    from quillspark.plans.asking import _cleaned_sql

    question = _KEYWORDS.format(found=contained_sql("lower(question)", L.SEARCH_ENTITIES), cut=_cleaned_sql("question")) if extracted else "question"
    l2 = "list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE)))"
    return f"""{_STATED}, asked AS (SELECT query_id, {question} AS question FROM stated), {_TERMS}, {_bm25_sql('text', _SDOCS, 'doc_id', 's')}, r AS (SELECT query_id, id, round(score, 6) AS score FROM s),
        a AS (SELECT query_id, id, score AS s1 FROM (SELECT *, {_RANK} AS n FROM r) WHERE n <= {k}),
        dd AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round({l2}, 6) + 0.0 AS distance FROM embeddings q JOIN stated ON q.vec_id = stated.query_id JOIN embeddings v ON true),
        b AS (SELECT query_id, id, round(1 / (1 + distance), 6) AS s2, n AS r2 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS n FROM dd) WHERE n <= {k}),
        ab AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id, s1, s2 FROM a FULL JOIN b ON a.query_id = b.query_id AND a.id = b.id)"""


def _merged_sql(k: int, extracted: bool, w: float) -> str:
    return f"""WITH {_side_sql(k, extracted)}, f AS (SELECT query_id, id, round(CASE WHEN s1 IS NOT NULL AND s2 IS NOT NULL THEN s1 * {w}::DOUBLE + s2 * {round(1 - w, 2)}::DOUBLE ELSE coalesce(s1, s2) END, 6) AS score, CASE WHEN s1 IS NOT NULL AND s2 IS NOT NULL THEN 'hybrid' WHEN s1 IS NOT NULL THEN 'keyword' ELSE 'semantic' END AS found_by FROM ab)
        SELECT query_id, id AS doc_id, found_by, score, hit_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS hit_rank FROM f) WHERE hit_rank <= 10"""


SQL = {
    "should_sum": f"WITH {CHUNKS}, {ASKED}, {_TERMS}, {_PARTS}, {_ALL}, r AS (SELECT query_id, id, round(12.0::DOUBLE * coalesce(chapter, 0.0) + 10.0::DOUBLE * coalesce(section, 0.0) + 3.0::DOUBLE * coalesce(content, 0.0), 6) AS score FROM g) {_BASE}",
    "constant_terms": f"WITH {CHUNKS}, {ASKED}, {_WORDS}, {_PARTS}, {_ALL}, r AS (SELECT query_id, id, CASE WHEN chapter IS NOT NULL THEN 2.5::DOUBLE ELSE 0 END + CASE WHEN section IS NOT NULL THEN 2.5::DOUBLE ELSE 0 END + CASE WHEN content IS NOT NULL THEN 2.0::DOUBLE ELSE 0 END AS score FROM g) {_BASE}",
    "must_not_subtypes": f"{P._WITH} SELECT hit_id, query_id, doc_id, hit_rank FROM qh WHERE NOT (contains(question, '{_TYPE}') AND NOT {any_of_sql('question', _SUBTYPES)} AND ({any_of_sql('content', _SUBTYPES)} OR {any_of_sql('chapter_title', _SUBTYPES)} OR {any_of_sql('section_title', _SUBTYPES)}))",
    "keyword_search_v1": _rescored_sql(25.0, 3.0, 20.0, False),
    "keyword_search_v2": _rescored_sql(60.0, 2.0, 75.0, True),
    "search_dispatch": """WITH log AS (SELECT DISTINCT query_id, search_type, top_k FROM query_log WHERE question IS NOT NULL AND search_type IS NOT NULL AND top_k IS NOT NULL AND CAST(regexp_extract(query_id, '([0-9]+)$', 1) AS BIGINT) % 100 = 0),
        sides AS (SELECT query_id, doc_id AS id, source, max(coalesce(score, 0.0)) AS score FROM search_results WHERE doc_id IS NOT NULL GROUP BY ALL),
        a AS (SELECT query_id, id, score AS s1 FROM sides WHERE source = 'elasticsearch'), b AS (SELECT query_id, id, score AS s2 FROM sides WHERE source = 'milvus'),
        ab AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id, s1, s2 FROM a FULL JOIN b ON a.query_id = b.query_id AND a.id = b.id),
        f AS (SELECT log.*, id, round(CASE WHEN search_type = 'keyword' THEN s1 WHEN search_type = 'semantic' THEN s2 WHEN s1 IS NOT NULL AND s2 IS NOT NULL THEN s1 * 0.5 + s2 * 0.5 ELSE coalesce(s1, s2) END, 6) AS score FROM log JOIN ab USING (query_id)
              WHERE CASE WHEN search_type = 'keyword' THEN s1 IS NOT NULL WHEN search_type = 'semantic' THEN s2 IS NOT NULL ELSE search_type IN ('hybrid', 'intelligent') END)
        SELECT query_id, search_type, id AS doc_id, score, hit_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, search_type, top_k ORDER BY score DESC, id) AS hit_rank FROM f) WHERE hit_rank <= top_k""",
    "hybrid_search_v1": _merged_sql(10, False, 0.5),
    "hybrid_search_v2": _merged_sql(20, True, 0.6),
    "distance_fusion": f"""WITH {_side_sql(20, False)}, na AS (SELECT query_id, id, CASE WHEN max(s1) OVER (PARTITION BY query_id) > 0 THEN s1 / max(s1) OVER (PARTITION BY query_id) ELSE 0.0 END AS n1 FROM a),
        e AS (SELECT query_id, id, 1 / s2 - 1 AS d FROM b), nb AS (SELECT query_id, id, CASE WHEN max(d) OVER (PARTITION BY query_id) > min(d) OVER (PARTITION BY query_id) THEN 1 - (d - min(d) OVER (PARTITION BY query_id)) / (max(d) OVER (PARTITION BY query_id) - min(d) OVER (PARTITION BY query_id)) ELSE 1.0 END AS n2 FROM e),
        f AS (SELECT ab.query_id, ab.id, round(0.6::DOUBLE * coalesce(n1, 0.0) + 0.4::DOUBLE * coalesce(n2, 0.0), 6) AS score FROM ab LEFT JOIN na ON ab.query_id = na.query_id AND ab.id = na.id LEFT JOIN nb ON ab.query_id = nb.query_id AND ab.id = nb.id)
        SELECT query_id, id AS doc_id, score, hit_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS hit_rank FROM f) WHERE hit_rank <= 10""",
    "semantic_search_v2": f"""WITH {_side_sql(10, False)}, x AS (SELECT b.query_id, b.id, r2, s2 AS score, question, text AS content, coalesce(title, '') AS chapter_title, '' AS section_title FROM b JOIN documents ON b.id = doc_id JOIN stated ON b.query_id = stated.query_id WHERE text IS NOT NULL),
        y AS (SELECT *, {P._DMF} FROM x) SELECT query_id, id AS doc_id, r2 AS base_rank, round(score * 0.7::DOUBLE + {P._F2} * 0.2::DOUBLE + {P._DENSITY} * 0.1::DOUBLE + 1e-9::DOUBLE, 4) AS score FROM y""",
    "keyword_search_v3": f"""WITH {CHUNKS}, {ASKED}, {_TERMS}, needed AS (SELECT query_id, count(*) AS needed FROM terms GROUP BY query_id), {_bm25_sql('content', 'chunks', 'doc_id', 's')},
        {_WORDS.replace('terms AS', 'words AS')}, {', '.join(f"w{i} AS (SELECT DISTINCT query_id, doc_id AS id FROM words JOIN (SELECT doc_id, unnest({tokens_sql(f)}) AS term FROM chunks) USING (term))" for i, f in enumerate(FIELDS))},
        u AS (SELECT query_id, id, score * 3.0::DOUBLE AS score FROM s UNION ALL SELECT query_id, id, score * 5.0::DOUBLE FROM s JOIN needed USING (query_id) WHERE matched = needed UNION ALL SELECT query_id, id, 2.5::DOUBLE FROM w0 UNION ALL SELECT query_id, id, 2.5::DOUBLE FROM w1 UNION ALL SELECT query_id, id, 2.0::DOUBLE FROM w2),
        r AS (SELECT query_id, id, round(sum(score), 6) AS score FROM u GROUP BY query_id, id), b AS ({_BASE}),
        x AS (SELECT b.*, question, c.content, c.chapter_title, c.section_title, {P._DMF} FROM b JOIN chunks c USING (doc_id) JOIN asked USING (query_id))
        SELECT query_id, doc_id, base_rank, round(score * 0.7::DOUBLE + {P._F2} * 0.2::DOUBLE + {P._DENSITY} * 0.1::DOUBLE + 1e-9::DOUBLE, 4) AS score FROM x""",
    "title_search": f"""WITH {CHUNKS}, asked AS (SELECT DISTINCT k AS query_id, k AS question FROM (SELECT unnest(keywords) AS k FROM questions WHERE CAST(regexp_extract(id, '([0-9]+)$', 1) AS BIGINT) % 100 = 0) WHERE k IS NOT NULL AND k <> ''), {_TERMS}, {_bm25_sql('content', 'chunks', 'doc_id', 's')},
        r AS (SELECT query_id, id, round(score + CASE WHEN contains(content, '# ' || query_id) THEN 3.0::DOUBLE ELSE 0 END + CASE WHEN contains(content, '## ' || query_id) THEN 2.0::DOUBLE ELSE 0 END + CASE WHEN contains(content, query_id) THEN 2.5::DOUBLE ELSE 0 END, 6) AS score FROM s JOIN chunks ON id = doc_id) {_BASE}""",
}
