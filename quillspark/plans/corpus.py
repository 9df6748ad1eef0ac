"""From raw texts to sections, chunks and their statistics; upserts and checks of stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.operators import chunking as C
from quillspark.operators import related
from quillspark.plans.common import CHUNKS, chunks
from quillspark.sources.tables import table

#: White space of any script, for both engines.
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _ids(spark: SparkSession, folder: str) -> DataFrame:
    return chunks(spark, folder).select("doc_id", "content")


def line_headings(spark: SparkSession, folder: str) -> DataFrame:
    rows = C.lines_of(_ids(spark, folder), "doc_id", "content")
    return rows.select(F.col("id").alias("doc_id"), C.heading_kind(F.col("line")).alias("kind")).groupBy("doc_id", "kind").agg(F.count("*").alias("lines"))


def section_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """Sections of every content: titles carried forward, page counter, body length."""
    return C.sections(_ids(spark, folder), "doc_id", "content").select(F.col("id").alias("doc_id"), "section_no", "chapter", "section", "page_no", F.length("body").alias("n_chars"))


def chunk_fixed(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of at most 500 characters with their id."""
    rows = C.fixed_chunks(table(spark, folder, "documents"), "doc_id", "text", 500)
    return rows.select(F.col("id").alias("doc_id"), "chunk_no", F.format_string("chunk_%d_%04d", F.col("id"), F.col("chunk_no")).alias("chunk_id"), F.length("chunk").alias("n_chars"), F.md5("chunk").alias("digest"))


def chunk_stats(spark: SparkSession, folder: str) -> DataFrame:
    docs = chunks(spark, folder)
    n = F.length("content")
    return docs.groupBy("collection").agg(F.count("*").alias("chunks"), F.sum(n).alias("chars"), F.round(F.avg(n), 6).alias("mean_chars"), F.countDistinct("chapter_title").alias("chapters"), F.countDistinct(F.when(F.col("section_title") != "", F.col("section_title"))).alias("sections"), F.round(F.sum(F.octet_length("content")) / 1048576.0, 6).alias("megabytes"))


def chunk_boundary(spark: SparkSession, folder: str) -> DataFrame:
    rows = C.boundary_chunks(_ids(spark, folder), "doc_id", "content")
    return rows.select(F.col("id").alias("doc_id"), "chunk_no", "chunk")


def toc_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Contents lines of documents: section number, title and page, the title cleaned of its page."""
    rows = C.lines_of(table(spark, folder, "documents"), "doc_id", "text")
    pattern = r"^(第[一二三四五六七八九十百]+[章节])\s*(.+?)\s*\.{3,}\s*([0-9]+)\s*$"
    return rows.where(F.col("line").rlike(pattern)).select(F.col("id").alias("doc_id"), "line_no", F.regexp_extract("line", pattern, 1).alias("number"), F.regexp_extract("line", pattern, 2).alias("title"), F.regexp_extract("line", pattern, 3).cast("int").alias("page"), C.without_page_number(F.col("line")).alias("cleaned"))


def toc_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Sections and page range of every chapter of the books."""
    t = table(spark, folder, "toc")
    after = F.lead("first_page").over(Window.partitionBy("book_id").orderBy("chapter_no", "section_no"))
    rows = t.withColumn("next_page", after)
    return rows.groupBy("book_id", "chapter_no").agg(F.count("section_title").alias("sections"), F.min("first_page").alias("first_page"), F.max(F.coalesce("next_page", "first_page")).alias("last_page"))


def titles_from_toc(spark: SparkSession, folder: str) -> DataFrame:
    """Contents of the table of contents that a chapter title of a hit names exactly, after page numbers are cut."""
    docs = chunks(spark, folder).where("chapter_title != ''").select("doc_id", C.without_page_number(F.col("chapter_title")).alias("chapter_title"))
    toc = table(spark, folder, "toc").select("book_id", "chapter_no", C.without_page_number(F.col("chapter_title")).alias("chapter_title")).distinct()
    return docs.join(toc, "chapter_title").groupBy("doc_id").agg(F.count("*").alias("books"), F.min("chapter_no").alias("chapter_no"))


def image_links(spark: SparkSession, folder: str) -> DataFrame:
    """Markdown links of documents: how many, distinct addresses, and the length of the text without them."""
    link = r"\[([^\[\]\n]*)\]\((https?://[^()\s]*)\)"
    docs = table(spark, folder, "documents").where("text IS NOT NULL")
    urls = F.regexp_extract_all("text", F.lit(link), F.lit(2))
    return docs.where(F.size(urls) > 0).select("doc_id", F.size(urls).alias("links"), F.size(F.array_distinct(urls)).alias("addresses"), F.length(F.regexp_replace("text", link, "")).alias("rest_chars"))


def clean_text(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("text IS NOT NULL")
    cleaned = C.clean_space(F.col("text"))
    return docs.select("doc_id", F.length(cleaned).alias("n_chars"), F.md5(cleaned).alias("digest"))


def figure_numbers(spark: SparkSession, folder: str) -> DataFrame:
    docs = _ids(spark, folder).withColumn("figure", C.figure_number(F.col("content")))
    return docs.where("figure IS NOT NULL").select("doc_id", "figure")


def previews(spark: SparkSession, folder: str) -> DataFrame:
    """Contents cut to 200 characters with a mark where something was cut."""
    cut = F.when(F.length("content") > 200, F.concat(F.substring("content", 1, 200), F.lit("..."))).otherwise(F.col("content"))
    return _ids(spark, folder).select("doc_id", F.md5(cut).alias("digest"), F.length(cut).alias("n_chars"))


def latest_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Upsert by hit id: of repeated deliveries the latest counts."""
    hits = table(spark, folder, "search_results")
    order = Window.partitionBy("hit_id").orderBy(F.col("ingested_at").desc_nulls_last(), F.col("retrieved_at").desc_nulls_last())
    rows = hits.select("hit_id", "query_id", "doc_id", "score", "retrieved_at", "ingested_at").withColumn("nth", F.row_number().over(order)).where("nth = 1")
    return rows.select("hit_id", "query_id", "doc_id", "score", F.unix_micros("retrieved_at").alias("retrieved_us"), F.unix_micros("ingested_at").alias("ingested_us"))


def late_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Deliveries by how late they came, and how many were repeats."""
    hits = table(spark, folder, "search_results").withColumn("hours", (F.unix_timestamp("ingested_at") - F.unix_timestamp("retrieved_at")) / 3600)
    bucket = F.when(F.col("hours") < 1, "under an hour").when(F.col("hours") < 24, "under a day").when(F.col("hours") < 168, "under a week").otherwise("later")
    return hits.where("hours IS NOT NULL").groupBy(bucket.alias("lateness")).agg(F.count("*").alias("deliveries"), F.countDistinct("hit_id").alias("hits"))


def store_check(spark: SparkSession, folder: str) -> DataFrame:
    """Per collection: documents, those without content, without titles, and hits."""
    hits = table(spark, folder, "search_results")
    untitled = F.coalesce("chapter_title", F.lit("")) == ""
    return hits.groupBy("collection").agg(F.countDistinct("doc_id").alias("documents"), F.countDistinct(F.when(F.col("content").isNull(), F.col("doc_id"))).alias("without_content"), F.countDistinct(F.when(untitled, F.col("doc_id"))).alias("without_title"), F.countDistinct("hit_id").alias("hits"))


def missing_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that the vector table lacks, by language."""
    docs = table(spark, folder, "documents").select("doc_id", F.coalesce("lang", F.lit("?")).alias("lang"))
    have = table(spark, folder, "embeddings").where("embedding IS NOT NULL").select(F.col("vec_id").alias("doc_id"))
    return docs.join(have, "doc_id", "left_anti").groupBy("lang").agg(F.count("*").alias("documents"))


def related_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Three documents of the same chapter for each: 10 for the same section, 5 times the shared share of the first 50 words.

    Documents of a chapter are compared in the task that holds it; three of each leave it.
    """
    # the white space of the SQL: spaces of any script at the ends, within a text none of them and no vertical tab
    text = F.regexp_replace(F.lower("content"), r"^\p{Zs}+|\p{Zs}+\z", "")
    first = F.array_distinct(F.slice(F.filter(F.split(text, r"[ \t\n\f\r]+"), lambda w: w != ""), 1, 50))
    docs = chunks(spark, folder).where("chapter_title != ''").withColumn("w", first)
    return _three_best(related.nearest_of_chapter(docs, 3, shared_only=True))


def _three_best(near: DataFrame) -> DataFrame:
    score = F.round(F.when(F.col("same"), 10.0).otherwise(0.0) + 5.0 * F.col("both") / F.greatest(F.col("n"), F.lit(1)), 6)
    best = Window.partitionBy("doc_id").orderBy(F.col("score").desc(), "other_id")
    return near.select("doc_id", "other_id", score.alias("score")).withColumn("nth", F.row_number().over(best).cast("long")).where("nth <= 3")


def related_chunks_all(spark: SparkSession, folder: str) -> DataFrame:
    """Three documents of the same chapter for each, of all others: 10 for the same section, 5 times the shared share of the first 50 words, ties by id.

    Blank titles are titles as well. Documents of a chapter are compared in the task that holds it; three of each leave it.
    """
    first = F.array_distinct(F.slice(F.filter(F.split(F.lower("content"), _SPACE), lambda w: w != ""), 1, 50))
    docs = chunks(spark, folder).select("doc_id", "chapter_title", "section_title", first.alias("w"))
    return _three_best(related.nearest_of_chapter(docs, 3, shared_only=False))


QUERIES = {f.__name__: f for f in (line_headings, section_bodies, chunk_fixed, chunk_stats, chunk_boundary, toc_lines, toc_sections, titles_from_toc, image_links, clean_text, figure_numbers, previews, latest_hits, late_hits, store_check, missing_vectors, related_chunks, related_chunks_all)}

_LINES = "lines AS (SELECT doc_id, regexp_replace(line, '\\r$', '') AS line, line_no FROM (SELECT doc_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM chunks))"
_KIND = r"CASE WHEN regexp_matches(line, '^#\s+(第[一二三四五六七八九十百]+章|Chapter\s+[0-9]+)') THEN 'chapter' WHEN regexp_matches(line, '^##\s+(第[一二三四五六七八九十百]+节|Section\s+[0-9]+)') THEN 'section' WHEN regexp_matches(line, '^##\s+') THEN 'other' ELSE 'body' END"
_NOPAGE = r"trim(regexp_replace(regexp_replace({c}, '[.．。·\s]*[0-9]+\s*$', ''), '[.．。·\s]+$', ''))"
_TOCP = r"^(第[一二三四五六七八九十百]+[章节])\s*(.+?)\s*\.{3,}\s*([0-9]+)\s*$"
_LINK = r"\[([^\[\]\n]*)\]\((https?://[^()\s]*)\)"
_CLEAN = r"trim(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'))"
_W50 = r"list_distinct(list_filter(string_split_regex(trim(lower(content)), '\s+'), lambda w: w <> '')[1:50])"
SQL = {
    "line_headings": f"WITH {CHUNKS}, {_LINES} SELECT doc_id, {_KIND} AS kind, count(*) AS lines FROM lines GROUP BY ALL",
    "section_bodies": rf"""WITH {CHUNKS}, {_LINES}, k AS (SELECT *, {_KIND} AS kind, trim(replace(line, '#', '')) AS title FROM lines),
        g AS (SELECT *, sum((kind <> 'body')::INT) OVER w AS section_no, coalesce(last_value(CASE WHEN kind = 'chapter' THEN title END IGNORE NULLS) OVER w, '') AS chapter,
              coalesce(last_value(CASE WHEN kind = 'chapter' THEN '' WHEN kind <> 'body' THEN title END IGNORE NULLS) OVER w, '') AS section, 1 + sum((kind IN ('chapter', 'section'))::INT) OVER w AS page_no
              FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
        SELECT doc_id, section_no::BIGINT AS section_no, chapter, section, page_no::BIGINT AS page_no, length(string_agg(line, chr(10)))::INTEGER AS n_chars FROM g WHERE kind = 'body' AND trim(line) <> '' GROUP BY doc_id, section_no, chapter, section, page_no""",
    "chunk_fixed": "WITH d AS (SELECT doc_id, text, unnest(generate_series(0, (length(text) - 1) // 500)) AS k FROM documents WHERE text IS NOT NULL AND length(text) > 0), c AS (SELECT doc_id, (k + 1)::INTEGER AS chunk_no, substring(text, k * 500 + 1, 500) AS chunk FROM d) SELECT doc_id, chunk_no, format('chunk_{:d}_{:04d}', doc_id, chunk_no) AS chunk_id, length(chunk)::INTEGER AS n_chars, md5(chunk) AS digest FROM c",
    "chunk_stats": f"WITH {CHUNKS} SELECT collection, count(*) AS chunks, sum(length(content))::BIGINT AS chars, round(avg(length(content)), 6) AS mean_chars, count(DISTINCT chapter_title) AS chapters, count(DISTINCT nullif(section_title, '')) AS sections, round(sum(strlen(content)) / 1048576.0, 6) AS megabytes FROM chunks GROUP BY collection",
    "toc_lines": f"WITH l AS (SELECT doc_id, regexp_replace(line, '\\r$', '') AS line, line_no FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents WHERE text IS NOT NULL)) SELECT doc_id, line_no::INTEGER AS line_no, regexp_extract(line, '{_TOCP}', 1) AS number, regexp_extract(line, '{_TOCP}', 2) AS title, regexp_extract(line, '{_TOCP}', 3)::INTEGER AS page, {_NOPAGE.format(c='line')} AS cleaned FROM l WHERE regexp_matches(line, '{_TOCP}')",
    "toc_sections": "WITH n AS (SELECT *, lead(first_page) OVER (PARTITION BY book_id ORDER BY chapter_no, section_no) AS next_page FROM toc) SELECT book_id, chapter_no, count(section_title) AS sections, min(first_page) AS first_page, max(coalesce(next_page, first_page)) AS last_page FROM n GROUP BY book_id, chapter_no",
    "titles_from_toc": f"WITH {CHUNKS}, d AS (SELECT doc_id, {_NOPAGE.format(c='chapter_title')} AS chapter_title FROM chunks WHERE chapter_title <> ''), t AS (SELECT DISTINCT book_id, chapter_no, {_NOPAGE.format(c='chapter_title')} AS chapter_title FROM toc) SELECT doc_id, count(*) AS books, min(chapter_no) AS chapter_no FROM d JOIN t USING (chapter_title) GROUP BY doc_id",
    "image_links": f"WITH d AS (SELECT doc_id, regexp_extract_all(text, '{_LINK}', 2) AS urls, text FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(urls)::INTEGER AS links, len(list_distinct(urls))::INTEGER AS addresses, length(regexp_replace(text, '{_LINK}', '', 'g'))::INTEGER AS rest_chars FROM d WHERE len(urls) > 0",
    "clean_text": f"SELECT doc_id, length({_CLEAN})::INTEGER AS n_chars, md5({_CLEAN}) AS digest FROM documents WHERE text IS NOT NULL",
    "figure_numbers": rf"WITH {CHUNKS}, f AS (SELECT doc_id, coalesce(nullif(regexp_extract(content, '图\s*([0-9]+-[0-9]+[a-z]?)', 1), ''), nullif(regexp_extract(content, 'Fig\.\s*([0-9]+[-.][0-9]+[a-z]?)', 1), ''), nullif(regexp_extract(content, '图\s*([0-9]+[a-z]?)', 1), '')) AS figure FROM chunks) SELECT doc_id, figure FROM f WHERE figure IS NOT NULL",
    "previews": f"WITH {CHUNKS}, p AS (SELECT doc_id, CASE WHEN length(content) > 200 THEN substring(content, 1, 200) || '...' ELSE content END AS cut FROM chunks) SELECT doc_id, md5(cut) AS digest, length(cut)::INTEGER AS n_chars FROM p",
    "latest_hits": "SELECT hit_id, query_id, doc_id, score, epoch_us(retrieved_at) AS retrieved_us, epoch_us(ingested_at) AS ingested_us FROM (SELECT *, row_number() OVER (PARTITION BY hit_id ORDER BY ingested_at DESC NULLS LAST, retrieved_at DESC NULLS LAST) AS nth FROM search_results) WHERE nth = 1",
    "late_hits": "WITH h AS (SELECT hit_id, (floor(epoch(ingested_at)) - floor(epoch(retrieved_at))) / 3600 AS hours FROM search_results) SELECT CASE WHEN hours < 1 THEN 'under an hour' WHEN hours < 24 THEN 'under a day' WHEN hours < 168 THEN 'under a week' ELSE 'later' END AS lateness, count(*) AS deliveries, count(DISTINCT hit_id) AS hits FROM h WHERE hours IS NOT NULL GROUP BY lateness",
    "store_check": "SELECT collection, count(DISTINCT doc_id) AS documents, count(DISTINCT CASE WHEN content IS NULL THEN doc_id END) AS without_content, count(DISTINCT CASE WHEN coalesce(chapter_title, '') = '' THEN doc_id END) AS without_title, count(DISTINCT hit_id) AS hits FROM search_results GROUP BY collection",
    "missing_vectors": "SELECT coalesce(lang, '?') AS lang, count(*) AS documents FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL) GROUP BY 1",
    "related_chunks": f"WITH {CHUNKS}, d AS (SELECT doc_id, chapter_title, section_title, {_W50} AS w FROM chunks WHERE chapter_title <> ''), p AS (SELECT a.doc_id, b.doc_id AS other_id, a.section_title = b.section_title AS same, len(list_intersect(a.w, b.w)) AS shared_words, len(a.w) AS n FROM d a JOIN d b ON a.chapter_title = b.chapter_title AND a.doc_id <> b.doc_id), s AS (SELECT doc_id, other_id, round(CASE WHEN same THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END + 5.0::DOUBLE * shared_words / n, 6) AS score FROM p WHERE shared_words > 0) SELECT doc_id, other_id, score, nth FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, other_id) AS nth FROM s) WHERE nth <= 3",
    "related_chunks_all": f"WITH {CHUNKS}, d AS (SELECT doc_id, chapter_title, section_title, list_distinct(list_filter(string_split_regex(lower(content), '{_SPACE}'), lambda w: w <> '')[1:50]) AS w FROM chunks), s AS (SELECT a.doc_id, b.doc_id AS other_id, round(CASE WHEN a.section_title = b.section_title THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END + 5.0::DOUBLE * len(list_intersect(a.w, b.w)) / greatest(len(a.w), 1), 6) AS score FROM d a JOIN d b ON a.chapter_title = b.chapter_title AND a.doc_id <> b.doc_id) SELECT doc_id, other_id, score, nth FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, other_id) AS nth FROM s) WHERE nth <= 3",
}
