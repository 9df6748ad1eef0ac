"""Previews, contexts and further judgements of hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import lexicons as L
from quillspark.functions.text import any_of, any_of_sql, contained, contained_sql, quoted
from quillspark.operators import chunking as C
from quillspark.operators import ranking as R
from quillspark.plans import ranking as plans
from quillspark.plans.common import CHUNKS, QUESTION_HITS, chunks, question_hits
from quillspark.sources.tables import table


def _expected(spark: SparkSession, folder: str) -> DataFrame:
    """Questions with the documents they expect and their first keyword."""
    q = table(spark, folder, "questions").where("size(keywords) > 0").select(F.col("id").alias("question_id"), F.element_at("keywords", 1).alias("word"), F.explode("expected_chunk_ids").alias("doc_id")).where("word != ''").distinct()
    return q.join(chunks(spark, folder).select("doc_id", "content"), "doc_id")


_EXPECTED = f"{CHUNKS}, ex AS (SELECT DISTINCT id AS question_id, keywords[1] AS word, unnest(expected_chunk_ids) AS doc_id FROM questions WHERE len(keywords) > 0 AND keywords[1] <> ''), qx AS (SELECT question_id, word, doc_id, content FROM ex JOIN chunks USING (doc_id))"


def smart_previews(spark: SparkSession, folder: str) -> DataFrame:
    """Five lines around the first that holds the question's keyword, else the first five."""
    lines = F.split("content", "\n")
    at = F.coalesce(F.array_position(F.transform(lines, lambda l: F.contains(l, F.col("word"))), F.lit(True)), F.lit(0)).cast("int")
    return _expected(spark, folder).select("question_id", "doc_id", "word", at.alias("line_no"), F.array_join(F.slice(lines, F.greatest(at - 2, F.lit(1)), F.lit(5)), " | ").alias("preview"))


def keyword_positions(spark: SparkSession, folder: str) -> DataFrame:
    """Where the keyword stands: in a heading, at the beginning, beside a figure, elsewhere, nowhere."""
    word = F.col("word")
    kind = F.when(F.contains("content", F.concat(F.lit("# "), word)), "heading").when(F.contains(F.substring("content", 1, 50), word), "beginning").when(F.contains("content", word) & F.contains("content", F.lit("图")), "figure").when(F.contains("content", word), "elsewhere").otherwise("nowhere")
    return _expected(spark, folder).groupBy("word", kind.alias("position")).agg(F.count("*").alias("documents"))


def comparison_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of documents that state likeness, difference, advantage or drawback, by the first group that fits."""
    rows = C.lines_of(table(spark, folder, "documents"), "doc_id", "text")
    kind = None
    for name, words in list(L.ALIKE.items())[::-1]:
        kind = F.when(any_of(F.col("line"), words), name) if kind is None else F.when(any_of(F.col("line"), words), name).otherwise(kind)
    return rows.withColumn("kind", kind).where("kind IS NOT NULL").groupBy(F.col("id").alias("doc_id"), "kind").agg(F.count("*").alias("lines"))


def quality_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Four simpler judgements of each query's hits, and the legacy confidence."""
    words = F.filter(F.split(F.lower("question"), r"\s+"), lambda w: w != "")
    share = lambda c: F.avg(c.cast("double"))
    per = question_hits(spark, folder).groupBy("query_id").agg(
        F.count("*").alias("n"),
        share(F.exists(words, lambda w: F.contains(F.lower("content"), w))).alias("relevant"),
        share(F.length("content") > 200).alias("long"),
        share(F.length("content") > 100).alias("fair"),
        share((F.col("chapter_title") != "") | (F.col("section_title") != "")).alias("titled"),
        F.avg(F.length("content")).alias("mean_length"),
        F.avg("score").alias("mean_score"),
    )
    many = lambda v: F.when(F.col("n") >= 3, v).otherwise(0.0)
    forms = {
        "tool": many(0.2) + 0.3 * F.col("relevant") + 0.3 * F.col("long") + 0.2 * F.col("titled"),
        "internal": many(0.3) + F.when(F.col("mean_length") > 150, 0.3).otherwise(0.0) + F.when(F.col("mean_score") > 0.5, 0.4).otherwise(0.0),
        "simple_tool": many(0.2) + 0.4 * F.col("relevant") + 0.4 * F.col("fair"),
        "simple_node": many(0.3) + F.least(F.col("mean_score"), F.lit(0.4)) + F.when(F.col("mean_length") > 150, 0.3).otherwise(0.0),
        "legacy": F.least(F.lit(0.9), F.col("n") / 10 * F.col("mean_score")),
    }
    return per.select("query_id", *[F.round(v + plans.TIE, 4).alias(k) for k, v in forms.items()])


def context_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The context of each query: its three best documents, numbered, cut to 200 characters."""
    hits = question_hits(spark, folder).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"), F.min("content").alias("content"), F.min("chapter_title").alias("title"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    top = hits.withColumn("nth", F.row_number().over(best)).where("nth <= 3")
    cut = F.when(F.length("content") > 200, F.concat(F.substring("content", 1, 200), F.lit("..."))).otherwise(F.col("content"))
    block = F.concat(F.lit("["), F.col("nth").cast("string"), F.lit("] "), F.col("title"), F.lit(": "), cut)
    return top.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", block.alias("block")))), lambda x: x["block"]), "\n---\n").alias("context"))


def intelligent_score(spark: SparkSession, folder: str) -> DataFrame:
    """Hybrid score raised by title priority, content class and concept relevance; rank within the query."""
    q, chapter, section, content = F.col("question"), F.col("chapter_title"), F.col("section_title"), F.col("content")
    kind, confidence = R.content_class(content, F.concat_ws(" ", chapter, section))
    level, relevance = R.concept_relevance(q, content)
    factor = F.when(level == "specific", 2.0).when(level == "basic", 1.5).otherwise(1.0)
    score = F.col("score") + 0.3 * R.title_priority(q, chapter, section) + F.when(kind == "rose_technology", 5.0).otherwise(0.0) + 3.0 * confidence + relevance * factor
    rows = question_hits(spark, folder).select("query_id", "hit_id", F.round(score + plans.TIE, 4).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "hit_id")
    return rows.withColumn("hit_rank", F.row_number().over(best).cast("long"))


def cell_features(spark: SparkSession, folder: str) -> DataFrame:
    """Cell features that documents name, and in how many."""
    docs = table(spark, folder, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.explode(contained(F.col("text"), L.CELL_FEATURES)).alias("feature")).groupBy("feature").agg(F.count("*").alias("documents"))


def entity_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Entities of each content by class, in the classes' order."""
    c = F.col("content")
    return chunks(spark, folder).select("doc_id", *[F.array_join(contained(c, lexicon), "|").alias(name) for name, lexicon in (("cancer_types", L.CANCER_TYPES), ("medical_words", L.MEDICAL_WORDS), ("anatomy", L.ANATOMY))])


def general_analysis(spark: SparkSession, folder: str) -> DataFrame:
    concepts = F.slice(contained(F.lower("content"), L.KEY_CONCEPTS), 1, 5)
    return chunks(spark, folder).select("doc_id", F.length("content").alias("n_chars"), F.array_join(concepts, "|").alias("concepts"), F.array_join(contained(F.col("content"), ["腺癌", "鳞癌", "ROSE"]), "|").alias("terms"))


def chapter_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """For each known entity the five documents with a section title that name it most often, contents pages skipped."""
    docs = chunks(spark, folder).where((F.col("section_title") != "") & ~F.substring("content", 1, 50).rlike("[录日]"))
    rows = docs.select("doc_id", "chapter_title", "section_title", "content", F.explode(contained(F.col("content"), L.KEY_ENTITIES)).alias("entity"))
    rows = rows.withColumn("times", ((F.length("content") - F.length(F.replace("content", F.col("entity"), F.lit("")))) / F.length("entity")).cast("long"))
    best = Window.partitionBy("entity").orderBy(F.col("times").desc(), "doc_id")
    return rows.withColumn("nth", F.row_number().over(best).cast("long")).where("nth <= 5").select("entity", "doc_id", "chapter_title", "section_title", "times", "nth")


def chapter_from_text(spark: SparkSession, folder: str) -> DataFrame:
    """First chapter and section title within the first 20 lines of a content, page digits cut."""
    lines = F.filter(F.slice(F.split("content", "\n"), 1, 20), lambda l: F.length(l) <= 100)
    cut = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "^#+", ""), r"[0-9]+\s*$", ""))
    rows = chunks(spark, folder).select("doc_id", cut(F.try_element_at(F.filter(lines, lambda l: l.rlike("第[一二三四五六七八九十]+章")), F.lit(1))).alias("chapter"), cut(F.try_element_at(F.filter(lines, lambda l: l.rlike("第[一二三四五六七八九十]+节")), F.lit(1))).alias("section"))
    return rows.where("chapter IS NOT NULL OR section IS NOT NULL")


def chunk_category(spark: SparkSession, folder: str) -> DataFrame:
    c = F.lower("chapter_title")
    kind = F.when(any_of(c, ["肺癌", "肺部实体"]), "lung_cancer").when(any_of(c, ["转移性", "其他"]), "metastatic_tumor").when(any_of(c, ["少见病"]), "rare_disease").when(any_of(c, ["技术", "组学"]), "rose_technique").otherwise("general")
    return chunks(spark, folder).groupBy(kind.alias("category"), "collection").agg(F.count("*").alias("chunks"))


def event_props(spark: SparkSession, folder: str) -> DataFrame:
    """Values of the events' JSON properties; broken JSON counts as null."""
    events = table(spark, folder, "events")
    return events.groupBy(F.get_json_object("props", "$.k").alias("k"), "event_type").agg(F.count("*").alias("events"))


QUERIES = {f.__name__: f for f in (cell_features, entity_classes, general_analysis, chapter_lookup, chapter_from_text, chunk_category, event_props, smart_previews, keyword_positions, comparison_lines, quality_forms, context_blocks, intelligent_score)}

_LINES = "string_split(content, chr(10))"
_KINDS = "CASE " + " ".join(f"WHEN {any_of_sql('line', w)} THEN '{n}'" for n, w in L.ALIKE.items()) + " END"
_N3 = "CASE WHEN n >= 3 THEN {v}::DOUBLE ELSE 0.0::DOUBLE END"
SQL = {
    "cell_features": f"WITH d AS (SELECT unnest({contained_sql('text', L.CELL_FEATURES)}) AS feature FROM documents WHERE text IS NOT NULL) SELECT feature, count(*) AS documents FROM d GROUP BY feature",
    "entity_classes": f"WITH {CHUNKS} SELECT doc_id, array_to_string({contained_sql('content', L.CANCER_TYPES)}, '|') AS cancer_types, array_to_string({contained_sql('content', L.MEDICAL_WORDS)}, '|') AS medical_words, array_to_string({contained_sql('content', L.ANATOMY)}, '|') AS anatomy FROM chunks",
    "general_analysis": f"WITH {CHUNKS} SELECT doc_id, length(content)::INTEGER AS n_chars, array_to_string({contained_sql('lower(content)', L.KEY_CONCEPTS)}[1:5], '|') AS concepts, array_to_string({contained_sql('content', ['腺癌', '鳞癌', 'ROSE'])}, '|') AS terms FROM chunks",
    "chapter_lookup": f"WITH {CHUNKS}, e AS (SELECT unnest([{', '.join(quoted(x) for x in L.KEY_ENTITIES)}]) AS entity), r AS (SELECT entity, doc_id, chapter_title, section_title, (length(content) - length(replace(content, entity, ''))) // length(entity) AS times FROM chunks, e WHERE section_title <> '' AND NOT regexp_matches(substring(content, 1, 50), '[录日]') AND contains(content, entity)) SELECT entity, doc_id, chapter_title, section_title, times, nth FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY times DESC, doc_id) AS nth FROM r) WHERE nth <= 5",
    "chapter_from_text": f"WITH {CHUNKS}, l AS (SELECT doc_id, list_filter({_LINES}[1:20], lambda x: length(x) <= 100) AS ls FROM chunks), f AS (SELECT doc_id, list_filter(ls, lambda x: regexp_matches(x, '第[一二三四五六七八九十]+章'))[1] AS c, list_filter(ls, lambda x: regexp_matches(x, '第[一二三四五六七八九十]+节'))[1] AS s FROM l) SELECT doc_id, trim(regexp_replace(regexp_replace(c, '^#+', ''), '[0-9]+\\s*$', '')) AS chapter, trim(regexp_replace(regexp_replace(s, '^#+', ''), '[0-9]+\\s*$', '')) AS section FROM f WHERE c IS NOT NULL OR s IS NOT NULL",
    "chunk_category": f"WITH {CHUNKS} SELECT CASE WHEN {any_of_sql('chapter_title', ['肺癌', '肺部实体'])} THEN 'lung_cancer' WHEN {any_of_sql('chapter_title', ['转移性', '其他'])} THEN 'metastatic_tumor' WHEN {any_of_sql('chapter_title', ['少见病'])} THEN 'rare_disease' WHEN {any_of_sql('chapter_title', ['技术', '组学'])} THEN 'rose_technique' ELSE 'general' END AS category, collection, count(*) AS chunks FROM chunks GROUP BY ALL",
    "event_props": "SELECT CASE WHEN json_valid(props) THEN json_extract_string(props, '$.k') END AS k, event_type, count(*) AS events FROM events GROUP BY ALL",
    "smart_previews": f"WITH {_EXPECTED}, l AS (SELECT *, {_LINES} AS ls, coalesce(list_position(list_transform({_LINES}, lambda x: contains(x, word)), true), 0)::INTEGER AS line_no FROM qx) SELECT question_id, doc_id, word, line_no, array_to_string(ls[greatest(line_no - 2, 1):greatest(line_no - 2, 1) + 4], ' | ') AS preview FROM l",
    "keyword_positions": f"WITH {_EXPECTED} SELECT word, CASE WHEN contains(content, '# ' || word) THEN 'heading' WHEN contains(substring(content, 1, 50), word) THEN 'beginning' WHEN contains(content, word) AND contains(content, '图') THEN 'figure' WHEN contains(content, word) THEN 'elsewhere' ELSE 'nowhere' END AS position, count(*) AS documents FROM qx GROUP BY ALL",
    "comparison_lines": f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL), k AS (SELECT doc_id, {_KINDS} AS kind FROM l) SELECT doc_id, kind, count(*) AS lines FROM k WHERE kind IS NOT NULL GROUP BY ALL",
    "quality_forms": rf"""WITH {QUESTION_HITS}, w AS (SELECT *, list_filter(string_split_regex(lower(question), '\s+'), lambda w: w <> '') AS ws FROM qh),
        p AS (SELECT query_id, count(*) AS n, avg(CASE WHEN len(list_filter(ws, lambda w: contains(lower(content), w))) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS relevant, avg(CASE WHEN length(content) > 200 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS long,
              avg(CASE WHEN length(content) > 100 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS fair, avg(CASE WHEN chapter_title <> '' OR section_title <> '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS titled, avg(length(content)) AS mean_length, avg(score) AS mean_score FROM w GROUP BY query_id)
        SELECT query_id, round({_N3.format(v=0.2)} + 0.3::DOUBLE * relevant + 0.3::DOUBLE * long + 0.2::DOUBLE * titled + 1e-9::DOUBLE, 4) AS tool,
               round({_N3.format(v=0.3)} + CASE WHEN mean_length > 150 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN mean_score > 0.5 THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END + 1e-9::DOUBLE, 4) AS internal,
               round({_N3.format(v=0.2)} + 0.4::DOUBLE * relevant + 0.4::DOUBLE * fair + 1e-9::DOUBLE, 4) AS simple_tool,
               round({_N3.format(v=0.3)} + least(mean_score, 0.4::DOUBLE) + CASE WHEN mean_length > 150 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END + 1e-9::DOUBLE, 4) AS simple_node,
               round(least(0.9::DOUBLE, n / 10 * mean_score) + 1e-9::DOUBLE, 4) AS legacy FROM p""",
    "context_blocks": f"WITH {QUESTION_HITS}, h AS (SELECT query_id, doc_id, max(score) AS score, min(content) AS content, min(chapter_title) AS title FROM qh GROUP BY query_id, doc_id), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS nth FROM h) SELECT query_id, string_agg('[' || nth || '] ' || title || ': ' || CASE WHEN length(content) > 200 THEN substring(content, 1, 200) || '...' ELSE content END, chr(10) || '---' || chr(10) ORDER BY nth) AS context FROM t WHERE nth <= 3 GROUP BY query_id",
    "intelligent_score": f"WITH {QUESTION_HITS}, x AS (SELECT *, {plans._COUNTS} FROM qh), y AS (SELECT query_id, hit_id, score, {plans._TITLE1} AS ts, {plans._K1} AS kind, {plans._F1} AS cf, {plans._QK} AS lv, {plans._QR} AS rl FROM x), z AS (SELECT query_id, hit_id, round(score + 0.3::DOUBLE * ts + CASE WHEN kind = 'rose_technology' THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END + 3.0::DOUBLE * cf + rl * CASE lv WHEN 'specific' THEN 2.0::DOUBLE WHEN 'basic' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END + 1e-9::DOUBLE, 4) AS score FROM y) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hit_id) AS hit_rank FROM z",
}
