"""Keyword and vector search, fusion and removal of repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.text import tokens, tokens_sql
from quillspark.operators import best, fusion, keyword, vectors
from quillspark.plans.common import ASKED, CHUNKS, asked, chunks
from quillspark.sources.tables import table

TOP = 10
BOOSTS = {"chapter_title": 12.0, "section_title": 10.0, "content": 3.0}


def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", "text")
    hits = best.best_documents(keyword.query_terms(asked(spark, folder)), docs, "doc_id", ["text"], TOP)
    return hits.select("query_id", F.col("id").alias("doc_id"), "score", "hit_rank")


def _bm25_sql(field: str, source: str, key: str, name: str) -> str:
    return f"""
    {name}_docs AS (SELECT {key} AS id, {tokens_sql(f"coalesce({field}, '')")} AS toks FROM {source}),
    {name}_post AS (SELECT id, len(toks) AS dl, unnest(toks) AS term FROM {name}_docs),
    {name}_tf AS (SELECT id, dl, term, count(*) AS tf FROM {name}_post WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
    {name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY term),
    {name} AS (SELECT query_id, id, count(*) AS matched, sum(ln(1 + ((SELECT count(*) FROM {name}_docs) - df + 0.5) / (df + 0.5)) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * dl / (SELECT avg(len(toks)) FROM {name}_docs)))) AS score
               FROM terms JOIN {name}_tf USING (term) JOIN {name}_df USING (term) GROUP BY query_id, id)"""


_TERMS = f"terms AS (SELECT DISTINCT query_id, unnest({tokens_sql('question')}) AS term FROM asked)"
_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)"


def multi_field_best(spark: SparkSession, folder: str) -> DataFrame:
    hits = best.best_documents(keyword.query_terms(asked(spark, folder)), chunks(spark, folder), "doc_id", list(BOOSTS), TOP, best.best_field_of(BOOSTS))
    return hits.select("query_id", F.col("id").alias("doc_id"), "score", "hit_rank")


def function_score(spark: SparkSession, folder: str) -> DataFrame:
    """BM25 of the content, times 2 for numbered sections, 5 for figures, 0.3 for short texts."""
    rules = [(F.col("section_title") != "", 2.0), (F.col("content").rlike(r"图\s*[0-9]|Fig\."), 5.0), (F.length("content") < 150, 0.3)]
    hits = best.best_documents(keyword.query_terms(asked(spark, folder)), chunks(spark, folder), "doc_id", ["content"], TOP, weight=keyword.filtered_weights(rules))
    return hits.select("query_id", F.col("id").alias("doc_id"), "score", "hit_rank")


def all_terms_match(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold every Latin word and number of a question."""
    terms = keyword.query_terms(asked(spark, folder)).where(F.col("term").rlike("^[a-z0-9]+$"))
    docs = table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", "text")
    found = keyword.all_terms(terms, keyword.bm25_scores(terms, docs, "doc_id", "text"))
    return found.select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


def phrase_match(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents hold each keyword of the questions as a phrase, letter case and white space apart."""
    phrases = table(spark, folder, "questions").select(F.explode("keywords").alias("phrase")).where("phrase IS NOT NULL AND length(phrase) >= 2").distinct()
    squeeze = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    keys = phrases.withColumn("squeezed", squeeze("phrase")).withColumn("size", F.length("squeezed")).where("size >= 2")
    texts = table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", squeeze("text").alias("t"))
    # phrases and texts meet on the phrase's first two characters, then the whole phrase is looked for
    heads = texts.select("doc_id", "t", F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit("(?s)(?=(..))"), F.lit(1)))).alias("head")).join(keys.select(F.substring("squeezed", 1, 2).alias("head")).distinct(), "head", "left_semi")
    met = heads.join(keys.withColumn("head", F.substring("squeezed", 1, 2)), "head").where(F.contains("t", F.col("squeezed")))
    counts = met.groupBy("phrase").agg(F.count("*").alias("documents"))
    return phrases.join(counts, "phrase", "left").select("phrase", F.coalesce("documents", F.lit(0)).alias("documents"))


def fuzzy_match(spark: SparkSession, folder: str) -> DataFrame:
    """Words of the corpus within the edit distance that each Latin question word allows."""
    terms = keyword.query_terms(table(spark, folder, "query_log").where("question IS NOT NULL")).where(F.col("term").rlike("^[a-z]{3,}$"))
    words = table(spark, folder, "documents").select(F.explode(tokens(F.coalesce("text", F.lit("")))).alias("word")).where(F.col("word").rlike("^[a-z]{2,}$"))
    return keyword.fuzzy_terms(terms, words)


def variant_search(spark: SparkSession, folder: str) -> DataFrame:
    """Hits of all search variants of a question, the first variant that finds a document counts."""
    from quillspark.operators.questions import variants

    texts = asked(spark, folder).select("query_id", F.posexplode(variants(F.col("question"))).alias("variant", "question"))
    keyed = texts.select(F.concat_ws("#", "query_id", F.col("variant").cast("string")).alias("query_id"), "question")
    docs = table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", "text")
    hits = best.best_documents(keyword.query_terms(keyed), docs, "doc_id", ["text"], TOP)
    hits = hits.select(F.split("query_id", "#").alias("k"), F.col("id").alias("doc_id"), "score", "hit_rank").select(F.col("k")[0].alias("query_id"), F.col("k")[1].cast("int").alias("variant"), "doc_id", "score", "hit_rank")
    return fusion.first_of_each(hits, F.col("doc_id"), "variant", "hit_rank")


def _asked_vectors(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return v, v.where(F.col("vec_id") % 100 == 0)


def vector_l2_topk(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.exact_topk(*_asked_vectors(spark, folder), TOP, "l2")


def vector_cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.exact_topk(*_asked_vectors(spark, folder), TOP, "cosine")


def hydrate_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Vector hits with their score and the document of the same number; hits without a document are dropped."""
    hits = vector_l2_topk(spark, folder)
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("vec_id"), "title", "lang", "n_chars")
    return hits.join(docs, "vec_id").select("query_vec", "vec_id", F.round(1 / (1 + F.col("distance")), 6).alias("score"), "title", "lang", "n_chars")


def vector_ivf_topk(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.ivf_topk(*_asked_vectors(spark, folder), TOP)


def vector_ivf_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Share of the exact top hits of the stated queries that the inverted file finds."""
    v, q = _asked_vectors(spark, folder)
    exact = vectors.exact_topk(v, q, TOP).select("query_vec", "vec_id")
    found = vectors.ivf_topk(v, q, TOP).select("query_vec", "vec_id", F.lit(1).alias("found"))
    return exact.join(found, ["query_vec", "vec_id"], "left").groupBy("query_vec").agg(F.count("*").alias("exact"), F.count("found").alias("found"))


def _sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    hits = table(spark, folder, "search_results").where("query_id IS NOT NULL AND doc_id IS NOT NULL")
    return fusion.side(hits, "elasticsearch"), fusion.side(hits, "milvus")


_SIDES = """sides AS (SELECT query_id, doc_id AS id, source, max(coalesce(score, 0.0)) AS score FROM search_results WHERE query_id IS NOT NULL AND doc_id IS NOT NULL GROUP BY ALL),
    a AS (SELECT query_id, id, score AS s1, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r1 FROM sides WHERE source = 'elasticsearch'),
    b AS (SELECT query_id, id, score AS s2, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r2 FROM sides WHERE source = 'milvus'),
    ab AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id, s1, r1, s2, r2 FROM a FULL JOIN b ON a.query_id = b.query_id AND a.id = b.id)"""


def hybrid_merge(spark: SparkSession, folder: str) -> DataFrame:
    return fusion.ranked(fusion.weighted_merge(*_sides(spark, folder), 0.6), TOP).select("query_id", F.col("id").alias("doc_id"), "score", "found_by", "hit_rank")


def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    return fusion.ranked(fusion.reciprocal_rank(*_sides(spark, folder)), TOP).select("query_id", F.col("id").alias("doc_id"), "score", "first_rank", "second_rank", "hit_rank")


def weighted_fusion(spark: SparkSession, folder: str) -> DataFrame:
    return fusion.ranked(fusion.normalised_merge(*_sides(spark, folder), 0.6), TOP).select("query_id", F.col("id").alias("doc_id"), "score", "hit_rank")


def adaptive_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """Fusion chosen by the question: reciprocal ranks for very short ones, three quarters keyword with a precise term, else six tenths."""
    from quillspark.operators.questions import has_precise_term

    first, second = _sides(spark, folder)
    log = table(spark, folder, "query_log").where("question IS NOT NULL").groupBy("query_id").agg(F.min("question").alias("question"))
    rrf = fusion.reciprocal_rank(first, second).select("query_id", "id", F.col("score").alias("rrf"))
    sharp = fusion.normalised_merge(first, second, 0.75).select("query_id", "id", F.col("score").alias("sharp"))
    wide = fusion.normalised_merge(first, second, 0.6).select("query_id", "id", F.col("score").alias("wide"))
    rows = rrf.join(sharp, ["query_id", "id"]).join(wide, ["query_id", "id"]).join(log, "query_id")
    score = F.when(F.length("question") <= 3, F.col("rrf")).when(has_precise_term(F.col("question")), F.col("sharp")).otherwise(F.col("wide"))
    return fusion.ranked(rows.select("query_id", "id", score.alias("score")), TOP).select("query_id", F.col("id").alias("doc_id"), "score", "hit_rank")


def dedup_id_or_prefix(spark: SparkSession, folder: str) -> DataFrame:
    hits = table(spark, folder, "search_results").select("hit_id", "query_id", "doc_id", "content", "hit_rank").distinct()
    return fusion.first_of_each(hits, fusion.id_or_prefix(), "hit_rank", "hit_id").select("query_id", "hit_id", "doc_id", "hit_rank")


def dedup_prefix(spark: SparkSession, folder: str) -> DataFrame:
    hits = table(spark, folder, "search_results").where("content IS NOT NULL").select("hit_id", "query_id", "doc_id", "content", "hit_rank").distinct()
    return fusion.first_of_each(hits, F.substring("content", 1, 100), "hit_rank", "hit_id").select("query_id", "hit_id", "doc_id", "hit_rank")


def post_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Filters that come after the top 5 of each query: pages 1 to 200, a chapter word, a least score."""
    hits = table(spark, folder, "search_results").groupBy("query_id", "doc_id").agg(F.max(F.coalesce("score", F.lit(0.0))).alias("score"), F.min("page_number").alias("page_number"), F.min(F.coalesce("chapter_title", F.lit(""))).alias("chapter_title"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    top = hits.withColumn("hit_rank", F.row_number().over(best).cast("long")).where("hit_rank <= 5")
    return top.where(F.col("page_number").between(1, 200) & F.col("chapter_title").rlike("癌|carcinoma|肺炎") & (F.col("score") >= 0.1)).select("query_id", "doc_id", F.round("score", 6).alias("score"), "hit_rank")


_VEC = "SELECT q.vec_id AS query_vec, v.vec_id, round({d}, 6) + 0.0 AS distance FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0"
_L2 = "list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE)))"
_COS = "1 - list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) / (sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(v.embedding, lambda x: x::DOUBLE * x::DOUBLE))))"
_TOPV = "SELECT query_vec, vec_id, distance, hit_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_vec ORDER BY distance, vec_id) AS hit_rank FROM d) WHERE hit_rank <= 10"

QUERIES = {f.__name__: f for f in (bm25_topk, multi_field_best, function_score, all_terms_match, phrase_match, fuzzy_match, variant_search, vector_l2_topk, vector_cosine_topk, hydrate_hits, vector_ivf_topk, vector_ivf_recall, hybrid_merge, rrf_fusion, weighted_fusion, adaptive_fusion, dedup_id_or_prefix, dedup_prefix, post_filter)}
_DOCS = "(SELECT doc_id, text FROM documents WHERE text IS NOT NULL)"
_FUSED = "SELECT query_id, id AS doc_id, {cols}score, hit_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS hit_rank FROM f) WHERE hit_rank <= 10"
_NORM = """na AS (SELECT query_id, id, CASE WHEN max(s1) OVER (PARTITION BY query_id) > 0 THEN s1 / max(s1) OVER (PARTITION BY query_id) ELSE 0.0 END AS n1 FROM a),
    nb AS (SELECT query_id, id, CASE WHEN max(s2) OVER (PARTITION BY query_id) > min(s2) OVER (PARTITION BY query_id) THEN (s2 - min(s2) OVER (PARTITION BY query_id)) / (max(s2) OVER (PARTITION BY query_id) - min(s2) OVER (PARTITION BY query_id)) ELSE 1.0 END AS n2 FROM b),
    n AS (SELECT ab.*, coalesce(n1, 0.0) AS n1, coalesce(n2, 0.0) AS n2 FROM ab LEFT JOIN na USING (query_id, id) LEFT JOIN nb USING (query_id, id))"""


def _precise_sql() -> str:
    from quillspark.functions.lexicons import PRECISE_TERMS
    from quillspark.functions.text import any_of_sql

    return f"({any_of_sql('upper(question)', PRECISE_TERMS)} OR {any_of_sql('question', PRECISE_TERMS)})"


SQL = {
    "variant_search": "",
    "bm25_topk": f"WITH {ASKED}, {_TERMS}, {_bm25_sql('text', _DOCS, 'doc_id', 's')}, r AS (SELECT query_id, id, round(score, 6) AS score FROM s) SELECT query_id, id AS doc_id, score, hit_rank FROM (SELECT *, {_RANK} AS hit_rank FROM r) WHERE hit_rank <= 10",
    "multi_field_best": f"WITH {CHUNKS}, {ASKED}, {_TERMS}, {', '.join(_bm25_sql(f, 'chunks', 'doc_id', f'f{i}') for i, f in enumerate(BOOSTS))}, u AS ({' UNION ALL '.join(f'SELECT query_id, id, score * {b} AS score FROM f{i}' for i, b in enumerate(BOOSTS.values()))}), r AS (SELECT query_id, id, round(max(score), 6) AS score FROM u GROUP BY query_id, id) SELECT query_id, id AS doc_id, score, hit_rank FROM (SELECT *, {_RANK} AS hit_rank FROM r) WHERE hit_rank <= 10",
    "function_score": f"WITH {CHUNKS}, {ASKED}, {_TERMS}, {_bm25_sql('content', 'chunks', 'doc_id', 's')}, r AS (SELECT query_id, id, round(score * (CASE WHEN section_title <> '' THEN 2.0 ELSE 1.0 END) * (CASE WHEN regexp_matches(content, '图\\s*[0-9]|Fig\\.') THEN 5.0 ELSE 1.0 END) * (CASE WHEN length(content) < 150 THEN 0.3 ELSE 1.0 END), 6) AS score FROM s JOIN chunks ON id = doc_id) SELECT query_id, id AS doc_id, score, hit_rank FROM (SELECT *, {_RANK} AS hit_rank FROM r) WHERE hit_rank <= 10",
    "all_terms_match": f"WITH {ASKED}, t0 AS (SELECT DISTINCT query_id, unnest({tokens_sql('question')}) AS term FROM asked), terms AS (SELECT * FROM t0 WHERE regexp_full_match(term, '[a-z0-9]+')), {_bm25_sql('text', _DOCS, 'doc_id', 's')}, needed AS (SELECT query_id, count(*) AS needed FROM terms GROUP BY query_id) SELECT query_id, id AS doc_id, round(score, 6) AS score FROM s JOIN needed USING (query_id) WHERE matched = needed",
    "phrase_match": "WITH p AS (SELECT DISTINCT phrase FROM (SELECT unnest(keywords) AS phrase FROM questions) WHERE phrase IS NOT NULL AND length(phrase) >= 2), t AS (SELECT doc_id, lower(regexp_replace(text, '\\s+', '', 'g')) AS t FROM documents WHERE text IS NOT NULL), k AS (SELECT phrase, lower(regexp_replace(phrase, '\\s+', '', 'g')) AS s FROM p) SELECT phrase, count(doc_id) AS documents FROM k LEFT JOIN t ON length(s) >= 2 AND contains(t.t, s) GROUP BY phrase",
    "fuzzy_match": f"WITH t AS (SELECT DISTINCT unnest({tokens_sql('question')}) AS term FROM query_log WHERE question IS NOT NULL), q AS (SELECT term, CASE WHEN length(term) <= 2 THEN 0 WHEN length(term) <= 5 THEN 1 ELSE 2 END AS edits FROM t WHERE regexp_full_match(term, '[a-z]{{3,}}')), w AS (SELECT DISTINCT word FROM (SELECT unnest({tokens_sql('text')}) AS word FROM documents WHERE text IS NOT NULL) WHERE regexp_full_match(word, '[a-z]{{2,}}')) SELECT term, word, levenshtein(term, word) AS distance FROM q JOIN w ON abs(length(term) - length(word)) <= edits AND levenshtein(term, word) <= edits",
    "vector_l2_topk": f"WITH d AS ({_VEC.format(d=_L2)}) {_TOPV}",
    "vector_cosine_topk": f"WITH d AS ({_VEC.format(d=_COS)}) {_TOPV}",
    "hydrate_hits": f"WITH d AS ({_VEC.format(d=_L2)}), h AS ({_TOPV}) SELECT query_vec, vec_id, round(1 / (1 + distance), 6) AS score, title, lang, n_chars FROM h JOIN documents ON doc_id = vec_id",
    "hybrid_merge": f"WITH {_SIDES}, f AS (SELECT query_id, id, round(CASE WHEN s1 IS NOT NULL AND s2 IS NOT NULL THEN s1 * 0.6 + s2 * 0.4 ELSE coalesce(s1, s2) END, 6) AS score, CASE WHEN s1 IS NOT NULL AND s2 IS NOT NULL THEN 'hybrid' WHEN s1 IS NOT NULL THEN 'keyword' ELSE 'semantic' END AS found_by FROM ab) {_FUSED.format(cols='found_by, ')}",
    "rrf_fusion": f"WITH {_SIDES}, f AS (SELECT query_id, id, round(coalesce(1.0 / (60 + r1), 0.0) + coalesce(1.0 / (60 + r2), 0.0), 6) AS score, coalesce(r1 - 1, -1) AS first_rank, coalesce(r2 - 1, -1) AS second_rank FROM ab) {_FUSED.format(cols='first_rank, second_rank, ')}",
    "weighted_fusion": f"WITH {_SIDES}, {_NORM}, f AS (SELECT query_id, id, round(0.6 * n1 + 0.4 * n2, 6) AS score FROM n) {_FUSED.format(cols='')}",
    "adaptive_fusion": f"WITH {_SIDES}, {_NORM}, log AS (SELECT query_id, min(question) AS question FROM query_log WHERE question IS NOT NULL GROUP BY query_id), f AS (SELECT query_id, id, round(CASE WHEN length(question) <= 3 THEN coalesce(1.0 / (60 + r1), 0.0) + coalesce(1.0 / (60 + r2), 0.0) WHEN {_precise_sql()} THEN 0.75 * n1 + 0.25 * n2 ELSE 0.6 * n1 + 0.4 * n2 END, 6) AS score FROM n JOIN log USING (query_id)) {_FUSED.format(cols='')}",
    "dedup_id_or_prefix": "WITH h AS (SELECT DISTINCT hit_id, query_id, doc_id, content, hit_rank FROM search_results) SELECT query_id, hit_id, doc_id, hit_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, coalesce(nullif(doc_id, ''), substring(coalesce(content, ''), 1, 100)) ORDER BY hit_rank, hit_id) AS nth FROM h) WHERE nth = 1",
    "dedup_prefix": "WITH h AS (SELECT DISTINCT hit_id, query_id, doc_id, content, hit_rank FROM search_results WHERE content IS NOT NULL) SELECT query_id, hit_id, doc_id, hit_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, substring(content, 1, 100) ORDER BY hit_rank, hit_id) AS nth FROM h) WHERE nth = 1",
    "post_filter": "WITH h AS (SELECT query_id, doc_id, max(coalesce(score, 0.0)) AS score, min(page_number) AS page_number, min(coalesce(chapter_title, '')) AS chapter_title FROM search_results GROUP BY query_id, doc_id), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS hit_rank FROM h) SELECT query_id, doc_id, round(score, 6) AS score, hit_rank FROM t WHERE hit_rank <= 5 AND page_number BETWEEN 1 AND 200 AND regexp_matches(chapter_title, '癌|carcinoma|肺炎') AND score >= 0.1",
}


def _variant_sql() -> str:
    from quillspark.functions.lexicons import KEY_ENTITIES
    from quillspark.functions.text import any_of_sql, contained_sql

    suffix = f"CASE WHEN {any_of_sql('question', ['图像', '特征'])} THEN ' 细胞形态 结构特征' WHEN {any_of_sql('question', ['病理', '诊断'])} THEN ' 病理特征 诊断要点' ELSE ' 图像特征 细胞学表现' END"
    first = ASKED.replace("asked AS", "asked0 AS", 1)
    return f"""WITH {first}, x AS (SELECT *, {contained_sql('question', KEY_ENTITIES)} AS es FROM asked0),
        v AS (SELECT query_id, CASE WHEN len(es) > 0 THEN [question, '第.*节 ' || es[1], es[1] || {suffix}] ELSE [question] END AS vs FROM x),
        asked AS (SELECT query_id || '#' || (generate_subscripts(vs, 1) - 1) AS query_id, unnest(vs) AS question FROM v), {_TERMS}, {_bm25_sql('text', _DOCS, 'doc_id', 's')},
        r AS (SELECT query_id, id, round(score, 6) AS score FROM s), h AS (SELECT *, {_RANK} AS hit_rank FROM r),
        k AS (SELECT split_part(query_id, '#', 1) AS query_id, split_part(query_id, '#', 2)::INTEGER AS variant, id AS doc_id, score, hit_rank FROM h WHERE hit_rank <= 10)
        SELECT query_id, variant, doc_id, score, hit_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY variant, hit_rank) AS nth FROM k) WHERE nth = 1"""


SQL["variant_search"] = _variant_sql()
