"""Structure inside texts, routes of questions, ranking by chapters and the making of sets, over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import lexicons as L
from quillspark.functions.text import any_of, any_of_sql, contained, contained_sql, quoted, words, words_sql
from quillspark.operators import questions as Q
from quillspark.operators import structure as S
from quillspark.plans import asking as A
from quillspark.plans import evaluating as E
from quillspark.plans.common import CHUNKS, QUESTION_HITS, chunks, question_hits
from quillspark.sources import files
from quillspark.sources.tables import table


def clean_titles(spark: SparkSession, folder: str) -> DataFrame:
    """All titles of hits and books, cleaned of numbers at their end, and the form of a section title."""
    hits, toc = table(spark, folder, "search_results"), table(spark, folder, "toc")
    titles = hits.select(F.col("chapter_title").alias("title")).union(hits.select("section_title")).union(toc.select("section_title"))
    return titles.where("title IS NOT NULL AND title != ''").distinct().select("title", S.clean_title(F.col("title")).alias("cleaned"), S.section_name(F.col("title")).alias("section_name"))


def image_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Images of documents, their alternative texts, and the text without them."""
    docs = table(spark, folder, "documents").where("text IS NOT NULL")
    rest = F.regexp_replace("text", S.IMAGE, "")
    alts, urls = (F.regexp_extract_all("text", F.lit(S.IMAGE), F.lit(k)) for k in (1, 2))
    return docs.select("doc_id", F.array_join(alts, "|").alias("alts"), F.array_join(urls, "|").alias("urls"), F.length(rest).alias("rest_chars"), F.md5(rest).alias("digest"))


def figure_labels(spark: SparkSession, folder: str) -> DataFrame:
    rows = chunks(spark, folder).select("doc_id", S.figure_label(F.col("content")).alias("figure"))
    return rows.where("figure IS NOT NULL")


def titles_in_text(spark: SparkSession, folder: str) -> DataFrame:
    """Chapter and section titles in the first lines of every content."""
    chapter, section = S.titles_in(F.col("content"))
    return chunks(spark, folder).select("doc_id", chapter.alias("chapter"), section.alias("section"))


def chapter_update(spark: SparkSession, folder: str) -> DataFrame:
    """Titles found in contents put into the documents: how many were processed, updated, unknown, and how many have titles after it."""
    docs = chunks(spark, folder)
    chapter, section = S.titles_in(F.col("content"))
    stored, counts = files.update_chapters(docs, docs.select("doc_id", chapter.alias("chapter_title"), section.alias("section_title")))
    return counts.join(stored.agg(F.count_if("has_chapter_info").alias("has_chapter")))


def feature_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """Phrases after a leading word, and in how many contents each stands."""
    return S.feature_phrases(chunks(spark, folder), "doc_id", "content").groupBy("phrase").agg(F.countDistinct("id").alias("documents"))


def embedded_json(spark: SparkSession, folder: str) -> DataFrame:
    """How JSON is found in event properties, bare, fenced and inside a sentence, and in answers."""
    props = table(spark, folder, "events").where("props IS NOT NULL").select("props")
    forms = F.array(F.struct(F.lit("bare").alias("form"), F.col("props").alias("t")), F.struct(F.lit("fenced").alias("form"), F.concat(F.lit("ok:\n```json\n"), F.col("props"), F.lit("\n```")).alias("t")), F.struct(F.lit("inside").alias("form"), F.concat(F.lit("it is "), F.col("props"), F.lit(", or so")).alias("t")))
    rows = props.select(F.explode(forms).alias("x")).select("x.*").unionByName(table(spark, folder, "responses").where("answer IS NOT NULL").select(F.lit("answer").alias("form"), F.col("answer").alias("t")))
    value, how = S.embedded_json(F.col("t"))
    return rows.select("form", how.alias("how"), F.get_json_object(value, "$.k").alias("k")).groupBy("form", "how").agg(F.count("*").alias("texts"), F.countDistinct("k").alias("values"))


def inline_options(spark: SparkSession, folder: str) -> DataFrame:
    """Options behind the words of the logged questions, parsed out again."""
    log = table(spark, folder, "query_log").where("question IS NOT NULL").select("query_id", "question", "top_k", "search_type").distinct()
    text = F.concat_ws(" ", "question", F.concat(F.lit("top_k="), F.col("top_k").cast("string")), F.concat(F.lit("search_type="), F.col("search_type")))
    return log.select("query_id", S.inline_options(text).alias("o")).select("query_id", "o.*").distinct()


def chapter_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Books put together from their contents table and the hits of their sections, and cut again by the order of headings alone."""
    toc = table(spark, folder, "toc")
    texts = chunks(spark, folder).where("chapter_title != '' AND section_title != ''").select("chapter_title", "section_title", "doc_id", F.concat(F.lit("> "), F.regexp_replace("content", r"\s+", " ")).alias("line"))
    pos = lambda part, chapter, section, kind, doc: F.struct(F.lit(part).alias("a"), chapter.alias("b"), section.alias("c"), F.lit(kind).alias("d"), doc.alias("e")).alias("pos")
    zero, none = F.lit(0), F.lit("")
    books = toc.select("book_id").distinct()
    chapters = toc.select("book_id", "chapter_no", "chapter_title").distinct()
    c, s = F.col("chapter_no"), F.col("section_no")
    parts = [
        books.select("book_id", pos(0, zero, zero, 0, none), F.lit("Preface of this book").alias("line")),
        books.select("book_id", pos(1, zero, zero, 0, none), F.lit("# 目 录").alias("line")),
        chapters.select("book_id", pos(2, c, zero, 0, none), F.concat("chapter_title", F.lit(" ..... 3")).alias("line")),
        toc.select("book_id", pos(2, c, s, 1, none), F.concat("section_title", F.lit("·····"), F.col("first_page").cast("string")).alias("line")),
        books.select("book_id", pos(3, zero, zero, 0, none), F.lit("参考文献").alias("line")),
        chapters.select("book_id", pos(4, c, zero, 0, none), F.concat(F.lit("# "), F.regexp_extract("chapter_title", f"^(第{S.NUMBER}+章)", 1)).alias("line")),
        toc.select("book_id", pos(4, c, s, 1, none), F.concat(F.lit("## "), F.regexp_extract("section_title", f"^(第{S.NUMBER}+节)", 1)).alias("line")),
        toc.join(texts, ["chapter_title", "section_title"]).select("book_id", pos(4, c, s, 2, F.col("doc_id")), "line"),
    ]
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.unionByName(part)
    chinese = toc.where(F.col("chapter_title").rlike(f"^第{S.NUMBER}+章")).select("book_id").distinct()
    return S.chunks_by_contents(lines.join(chinese, "book_id", "left_semi").withColumnRenamed("book_id", "id")).select(F.col("id").alias("book_id"), "chapter_no", "section_no", "chapter", "section", "lines", "chars")


def page_document(spark: SparkSession, folder: str) -> DataFrame:
    """Contents of every collection as lines under page headings: lines and characters of each page."""
    lines = chunks(spark, folder).select("collection", "page_number", "doc_id", F.posexplode(F.split("content", "\n")).alias("pos", "line")).select("collection", "page_number", "doc_id", (F.col("pos") + 1).alias("line_no"), "line")
    rows = files.page_lines(lines, "collection")
    return rows.groupBy("collection", "page").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"), F.max(F.when(F.col("line_no") == 0, F.col("line"))).alias("heading"))


def message_roles(spark: SparkSession, folder: str) -> DataFrame:
    """Questions and answers as messages, their roles in the names that models expect; unknown roles count as the user's."""
    roles = F.create_map(*[F.lit(x) for pair in _ROLES.items() for x in pair])
    asked = table(spark, folder, "query_log").select("query_id", F.lit("human").alias("kind"), "search_type").distinct()
    answered = table(spark, folder, "responses").where("answer IS NOT NULL").select("query_id", F.lit("ai").alias("kind"), F.lit(None).cast("string").alias("search_type")).distinct()
    tools = asked.where("search_type IS NOT NULL").select("query_id", F.lit("tool").alias("kind"), "search_type").union(asked.where("search_type IS NOT NULL").select("query_id", F.lit("note").alias("kind"), "search_type"))
    rows = asked.unionByName(answered).unionByName(tools)
    return rows.groupBy("kind").agg(F.first(F.coalesce(roles[F.col("kind")], F.lit("user"))).alias("role"), F.count("*").alias("messages"))


_ROLES = {"system": "system", "human": "user", "ai": "assistant", "tool": "tool"}


def need_search(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a question needs a search: not if it is a general one without any keyword of its own or entity."""
    log = A._log(spark, folder)
    kind = Q.query_type(F.col("question"))
    needs = (kind != "general") | (F.size(contained(F.col("question"), L.KEY_ENTITIES)) > 0)
    return log.select("query_id", kind.alias("query_type"), F.when(needs, "use_tools").otherwise("direct_response").alias("route")).distinct()


def _best_titles(spark: SparkSession, folder: str) -> DataFrame:
    """The titles of the first hits of each question, up to three, in order."""
    w = Window.partitionBy("query_id").orderBy("hit_rank", "hit_id")
    rows = question_hits(spark, folder).withColumn("nth", F.row_number().over(w)).where("nth <= 3")
    return rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "chapter_title", "section_title"))), lambda x: F.struct(x["chapter_title"].alias("chapter"), x["section_title"].alias("section"))).alias("infos"))


def chapter_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Search texts from the first entity of a question and the titles of its best hit."""
    rows = question_hits(spark, folder).select("query_id", "question").distinct().join(_best_titles(spark, folder), "query_id")
    entity = F.try_element_at(contained(F.col("question"), L.KEY_ENTITIES), F.lit(1))
    rows = rows.withColumn("entity", F.coalesce(entity, F.try_element_at(Q.fallback_keywords(F.col("question")), F.lit(1))))
    c, s, e = F.col("infos")[0]["chapter"], F.col("infos")[0]["section"], F.col("entity")
    both = F.array(F.concat_ws(" ", c, s, e), F.concat_ws(" ", c, e), F.concat_ws(" ", s, e))
    more = F.when((c != "") & (s != ""), both).when(s != "", F.array(F.concat_ws(" ", s, e))).when(c != "", F.array(F.concat_ws(" ", c, e))).otherwise(F.array().cast("array<string>"))
    texts = F.concat(F.array(e, F.concat(F.lit("第.*节 "), e)), more)
    return rows.select("query_id", F.posexplode(texts).alias("variant", "search_text"))


def decomposed(spark: SparkSession, folder: str) -> DataFrame:
    """One search text for each entity of a question: a known disease with the suffix of the question's topic, others with the plain one."""
    log = A._log(spark, folder)
    question = F.col("question")
    suffix = F.when(any_of(question, ["图像", "特征"]), " 细胞形态 结构特征").when(any_of(question, ["病理", "诊断"]), " 病理特征 诊断要点").otherwise(" 图像特征 细胞学表现")
    rows = log.select("query_id", suffix.alias("suffix"), F.posexplode(contained(question, _ENTITIES)).alias("entity_no", "entity"))
    return rows.select("query_id", "entity_no", "entity", F.concat("entity", F.when(F.col("entity").isin(_DISEASES), F.col("suffix")).otherwise(" 图像特征")).alias("search_text"))


_DISEASES = [e for e in L.QUESTION_ENTITIES if e.endswith("癌")]
_ENTITIES = _DISEASES + ["细胞学", "病理学", "预后", "胞质", "染色质", "核仁"]


def merged_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Hits of all entities of a question, those of the first entity first."""
    hits = question_hits(spark, folder)
    each = hits.select("query_id", "hit_id", "hit_rank", "content", F.posexplode(contained(F.col("question"), _ENTITIES)).alias("entity_no", "entity")).where(F.contains("content", F.col("entity")))
    w = Window.partitionBy("query_id").orderBy("entity_no", "hit_rank", "hit_id")
    return each.withColumn("position", F.row_number().over(w).cast("long")).select("query_id", "position", "entity", "hit_id")


def query_boost(spark: SparkSession, folder: str) -> DataFrame:
    """The weight of a question's topic: looks 2.5, diagnosis 2, cells 1.8, others 1."""
    q = F.lower("question")
    out = F.lit(1.0)
    for lexicon, weight in _TOPICS[::-1]:
        out = F.when(any_of(q, lexicon), weight).otherwise(out)
    return A._log(spark, folder).select("query_id", out.alias("boost")).distinct()


_TOPICS = [(["图像", "特征", "镜下", "形态"], 2.5), (["诊断", "标准", "要点"], 2.0), (["细胞", "核", "质", "形态"], 1.8)]


def chapter_matching(spark: SparkSession, folder: str) -> DataFrame:
    """How well a hit's titles match the question and the titles of its first three hits, capped at 150.

    50 for each chapter word of the question in a title; of the three titles in turn 100 for both equal, which ends the scan, 60 for
    the same chapter, else 70 for the same section; 40 and 50 for each entity in the chapter and section title.
    """
    rows = question_hits(spark, folder).join(_best_titles(spark, folder), "query_id")
    c, s = F.lower("chapter_title"), F.lower("section_title")
    words_in = F.filter(Q.chapter_keywords(F.col("question")), lambda k: F.contains(F.col("chapter_title"), k) | F.contains(F.col("section_title"), k))

    def step(acc, info):
        same_c, same_s = F.lower(info["chapter"]) == c, F.lower(info["section"]) == s
        more = F.when(acc["done"], 0.0).when(same_c & same_s, 100.0).when(same_c, 60.0).when(same_s, 70.0).otherwise(0.0)
        return F.struct((acc["score"] + more).alias("score"), (acc["done"] | (same_c & same_s)).alias("done"))

    scanned = F.aggregate("infos", F.struct(F.lit(0.0).alias("score"), F.lit(False).alias("done")), step)["score"]
    entities = contained(F.col("question"), _ENTITIES)
    named = F.size(F.filter(entities, lambda e: F.contains(c, F.lower(e)))) * 40.0 + F.size(F.filter(entities, lambda e: F.contains(s, F.lower(e)))) * 50.0
    return rows.select("hit_id", F.least(F.size(words_in) * 50.0 + scanned + named, F.lit(150.0)).alias("matching"))


def mapped_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Retrieved ids in the form of the expected ones: an expected id stays, a chunk gives its number, others their place."""
    rows = E._results(spark, folder).select("question_id", "method", F.coalesce("expected_chunk_ids", F.array().cast("array<string>")).alias("expected"), F.posexplode("retrieved_chunk_ids").alias("at", "id"))
    number = F.regexp_extract("id", "^chunk_([0-9]+)$", 1)
    mapped = F.when(F.array_contains("expected", F.col("id")), F.col("id")).when(number != "", F.format_string("doc_%04d", number.cast("long"))).otherwise(F.format_string("doc_%04d", F.col("at").cast("long") + 1))
    return rows.select("question_id", "method", (F.col("at") + 1).alias("place"), mapped.alias("mapped_id")).distinct()


def concepts_by_category(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct concepts of each disease category in order."""
    rows = table(spark, folder, "questions").select(F.coalesce("disease_category", F.lit("")).alias("category"), F.explode("related_concepts").alias("concept")).where("concept IS NOT NULL").distinct()
    return rows.groupBy("category").agg(F.count("*").alias("concepts"), F.array_join(F.array_sort(F.collect_list("concept")), "|").alias("names"))


def context_relevancy(spark: SparkSession, folder: str) -> DataFrame:
    """Mean over the hits of a question: seven tenths of the capped score and three tenths of the share of its words in the content."""
    hits = question_hits(spark, folder)
    w = F.array_distinct(words(F.lower("question")))
    share = F.when(F.size(w) > 0, F.size(F.filter(w, lambda x: F.contains(F.lower("content"), x))) / F.size(w)).otherwise(0.0)
    return hits.groupBy("query_id").agg(F.round(F.avg(F.least("score", F.lit(1.0)) * 0.7 + share * 0.3) + 1e-9, 6).alias("relevancy"), F.count("*").alias("hits"))


_SPLIT = {"rare": (0.5, 0.35), "technique": (0.7, 0.25)}


def difficulty_split(spark: SparkSession, folder: str) -> DataFrame:
    """Questions of each type by difficulty, as the shares of the type want it: basic first, then medium, the rest hard."""
    rows = table(spark, folder, "questions").select("id", "question_type").where("id IS NOT NULL").distinct()
    w = Window.partitionBy("question_type")
    rows = rows.withColumn("n", F.count("*").over(w)).withColumn("nth", F.row_number().over(w.orderBy(F.md5("id"), "id")))
    basic, medium = F.lit(0.6), F.lit(0.3)
    for name, (a, b) in _SPLIT.items():
        basic, medium = F.when(F.col("question_type") == name, a).otherwise(basic), F.when(F.col("question_type") == name, b).otherwise(medium)
    first, second = F.floor(F.col("n") * basic + 1e-9), F.floor(F.col("n") * medium + 1e-9)
    level = F.when(F.col("nth") <= first, "basic").when(F.col("nth") <= first + second, "medium").otherwise("hard")
    return rows.groupBy("question_type", level.alias("level")).agg(F.count("*").alias("questions"))


def type_quotas(spark: SparkSession, folder: str) -> DataFrame:
    """How many questions of each type a set of the table's size should have, rounded down, and how many there are."""
    rows = table(spark, folder, "questions").select("id", F.coalesce("question_type", F.lit("")).alias("question_type")).distinct()
    counts = rows.groupBy("question_type").agg(F.count("*").alias("have"))
    share = F.try_element_at(F.create_map(*[F.lit(x) for pair in _QUOTAS.items() for x in pair]), F.col("question_type"))
    total = counts.agg(F.sum("have").alias("total")).scalar()
    return counts.select("question_type", "have", F.floor(total * F.coalesce(share, F.lit(0.0)) + 1e-9).alias("wanted"))


_QUOTAS = {"diagnosis": 0.35, "differential": 0.25, "concept": 0.25, "technique": 0.15}


def shuffled_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Questions in a shuffled order with new consecutive ids: places in each of 256 slices of the hash, moved by the sizes of those before."""
    rows = table(spark, folder, "questions").where("id IS NOT NULL").select("id").distinct().withColumn("h", F.md5("id")).withColumn("slice", F.substring("h", 1, 2))
    sizes = rows.groupBy("slice").agg(F.count("*").alias("n"))
    before = sizes.select("slice", (F.sum("n").over(Window.orderBy("slice")) - F.col("n")).alias("before"))
    placed = rows.withColumn("nth", F.row_number().over(Window.partitionBy("slice").orderBy("h", "id"))).join(F.broadcast(before), "slice")
    return placed.select("id", F.format_string("med_q_%04d", F.col("before") + F.col("nth")).alias("new_id"))


def prompt_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a question is asked over several chunks (cases and differentials of medium or hard level), and its expected ids, four at most."""
    rows = table(spark, folder, "questions").select("id", "question_type", "difficulty", F.coalesce("expected_chunk_ids", F.array().cast("array<string>")).alias("ids")).distinct()
    several = F.coalesce(F.col("question_type").isin("differential", "differential_diagnosis", "case", "case_analysis") & F.col("difficulty").isin("medium", "hard"), F.lit(False))
    return rows.select("id", F.when(several, "several").otherwise("single").alias("form"), F.array_join(F.slice("ids", 1, 4), "|").alias("ids")).distinct()


QUERIES = {f.__name__: f for f in (clean_titles, image_extraction, figure_labels, titles_in_text, chapter_update, feature_phrases, embedded_json, inline_options, chapter_chunks, page_document, message_roles, need_search, chapter_queries, decomposed, merged_entities, query_boost, chapter_matching, mapped_ids, concepts_by_category, context_relevancy, difficulty_split, type_quotas, shuffled_ids, prompt_forms)}


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '{S.ENDS}', '', 'g')"


def _clean(c: str) -> str:
    return _strip(rf"regexp_replace(regexp_replace({c}, '[.．。·\s]*[0-9]+[^\n]*$', ''), '[.．。·]+$', '')")


def _section(c: str) -> str:
    cleaned = _clean(f"regexp_replace({c}, '^[# ]+', '')")
    return f"CASE WHEN regexp_matches({cleaned}, '^第{S.NUMBER}+节') THEN {_strip('regexp_extract(' + cleaned + f', {quoted(f"^(第{S.NUMBER}+节)")}, 1) || {quoted(" ")} || ' + _strip(f'regexp_replace({cleaned}, {quoted(f"^第{S.NUMBER}+节")}, {quoted("")})'))} ELSE {cleaned} END"


_N = f"第{S.NUMBER}+"
_BARE = _strip("regexp_replace(l, '^#+|#+$', '', 'g')")
_TITLES_IN = f"""tl AS (SELECT doc_id, content, chapter_title, section_title, list_transform(string_split(content, chr(10))[1:15], lambda l: {_strip('l')}) AS ls FROM chunks),
    tp AS (SELECT *, coalesce(list_filter(ls[1:10], lambda l: regexp_matches(l, '{_N}[章节]'))[1], list_filter(ls, lambda l: length(l) BETWEEN 6 AND 99 AND (regexp_matches(l, '{_N}[章节]') OR (starts_with(l, '#') AND {_BARE} <> '')))[1], '') AS l FROM tl),
    tq AS (SELECT *, CASE WHEN regexp_matches(l, '{_N}[章节]') THEN l ELSE {_BARE} END AS t FROM tp),
    tr AS (SELECT *, CASE WHEN regexp_matches(l, '{_N}[章节]') THEN regexp_matches(l, '{_N}章') ELSE contains(t, '章') END AS is_c FROM tq),
    found AS (SELECT doc_id, chapter_title, section_title, CASE WHEN is_c THEN t ELSE '' END AS chapter, CASE WHEN NOT is_c AND (regexp_matches(l, '{_N}[章节]') OR contains(t, '节')) THEN t ELSE '' END AS section FROM tr)"""
_ARR = "[" + ", ".join(quoted(e) for e in _ENTITIES) + "]"
_KEYW = " || ".join(f"regexp_extract_all(question, '{p}')" for p in ("第[一二三四五六七八九十]+章", "第[一二三四五六七八九十]+节", "第[0-9]+章", "第[0-9]+节"))
_BT = f"bt AS (SELECT query_id, list(struct_pack(chapter := chapter_title, section := section_title) ORDER BY nth) AS infos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hit_rank, hit_id) AS nth FROM qh) WHERE nth <= 3 GROUP BY query_id)"


def _scan_sql() -> str:
    out = "0.0::DOUBLE"
    for k in (3, 2, 1):
        i = f"infos[{k}]"
        c, s = f"lower({i}.chapter) = lower(chapter_title)", f"lower({i}.section) = lower(section_title)"
        out = f"CASE WHEN len(infos) < {k} THEN 0.0::DOUBLE WHEN {c} AND {s} THEN 100.0::DOUBLE WHEN {c} THEN 60.0::DOUBLE + {out} WHEN {s} THEN 70.0::DOUBLE + {out} ELSE {out} END"
    return out


_FOUND_IN = " || ".join(rf"regexp_extract_all(content, '{lead}[^\n]*?[:：]\s*([^\n]+)', 1)" for lead in S.FEATURE_LEADS)
SQL = {
    "clean_titles": f"WITH t AS (SELECT chapter_title AS title FROM search_results UNION SELECT section_title FROM search_results UNION SELECT section_title FROM toc) SELECT title, {_clean('title')} AS cleaned, {_section('title')} AS section_name FROM t WHERE title IS NOT NULL AND title <> ''",
    "image_extraction": rf"SELECT doc_id, array_to_string(regexp_extract_all(text, '{S.IMAGE}', 1), '|') AS alts, array_to_string(regexp_extract_all(text, '{S.IMAGE}', 2), '|') AS urls, length(regexp_replace(text, '{S.IMAGE}', '', 'g'))::INTEGER AS rest_chars, md5(regexp_replace(text, '{S.IMAGE}', '', 'g')) AS digest FROM documents WHERE text IS NOT NULL",
    "figure_labels": rf"WITH {CHUNKS}, f AS (SELECT doc_id, coalesce(nullif(regexp_extract(content, '图\s*([0-9]+-[0-9]+[a-z]?)', 1), ''), nullif(regexp_extract(content, '图\s*([0-9]+[a-z]?)', 1), ''), nullif(regexp_extract(content, '图\s*([一二三四五六七八九十]+[a-z]?)', 1), '')) AS figure FROM chunks) SELECT doc_id, figure FROM f WHERE figure IS NOT NULL",
    "titles_in_text": f"WITH {CHUNKS}, {_TITLES_IN} SELECT doc_id, chapter, section FROM found",
    "chapter_update": f"WITH {CHUNKS}, {_TITLES_IN} SELECT count(*) AS processed, count(*) FILTER (chapter <> '' OR section <> '') AS updated, 0::BIGINT AS failed, count(*) FILTER (chapter <> '' OR section <> '' OR trim(chapter_title) <> '') AS has_chapter FROM found",
    "feature_phrases": f"WITH {CHUNKS}, m AS (SELECT doc_id, unnest({_FOUND_IN}) AS t FROM chunks), p AS (SELECT doc_id, replace(replace({_strip('part')}, '\"', ''), '''', '') AS phrase FROM (SELECT doc_id, unnest(string_split(t, '，')) AS part FROM m)) SELECT phrase, count(DISTINCT doc_id) AS documents FROM p WHERE length(phrase) BETWEEN 3 AND 99 GROUP BY phrase",
    "embedded_json": f"""WITH p AS (SELECT props FROM events WHERE props IS NOT NULL), r AS (SELECT 'bare' AS form, props AS t FROM p UNION ALL SELECT 'fenced', 'ok:' || chr(10) || '```json' || chr(10) || props || chr(10) || '```' FROM p UNION ALL SELECT 'inside', 'it is ' || props || ', or so' FROM p UNION ALL SELECT 'answer', answer FROM responses WHERE answer IS NOT NULL),
        s AS (SELECT form, {_strip('t')} AS w FROM r), b AS (SELECT *, regexp_extract(w, '(?s)```json\\s*(\\{{.*?\\}})\\s*```', 1) AS f, regexp_extract(w, '(?s)(\\{{.*\\}})', 1) AS g FROM s),
        h AS (SELECT *, CASE WHEN w <> '' AND json_valid(w) THEN 'whole' WHEN f <> '' AND json_valid(f) THEN 'fenced' WHEN g <> '' AND json_valid(g) THEN 'braced' ELSE 'none' END AS how FROM b)
        SELECT form, how, count(*) AS texts, count(DISTINCT CASE how WHEN 'whole' THEN json_extract_string(w, '$.k') WHEN 'fenced' THEN json_extract_string(f, '$.k') WHEN 'braced' THEN json_extract_string(g, '$.k') END) AS values FROM h GROUP BY ALL""",
    "inline_options": f"WITH l AS (SELECT DISTINCT query_id, question, top_k, search_type FROM query_log WHERE question IS NOT NULL) SELECT DISTINCT query_id, array_to_string(list_filter(string_split_regex({_strip('question')}, '\\s+'), lambda w: w <> ''), ' ') AS question, coalesce(top_k, 5) AS top_k, CASE WHEN search_type IN ('hybrid', 'keyword', 'vector') THEN search_type ELSE 'hybrid' END AS search_type, 'default' AS model FROM l",
    "chapter_chunks": f"""WITH {CHUNKS}, zh AS (SELECT DISTINCT book_id FROM toc WHERE regexp_matches(chapter_title, '^{_N}章')), t AS (SELECT * FROM toc SEMI JOIN zh USING (book_id)),
        j AS (SELECT t.*, '> ' || regexp_replace(content, '\\s+', ' ', 'g') AS line FROM t JOIN chunks c ON t.chapter_title = c.chapter_title AND t.section_title = c.section_title WHERE t.chapter_title <> '' AND t.section_title <> '')
        SELECT book_id, dense_chapter AS chapter_no, dense_section AS section_no, {_clean('chapter_title')} AS chapter, {_section('section_title')} AS section, count(line) AS lines, sum(length(line))::BIGINT AS chars
        FROM (SELECT j.*, d.dense_chapter, d.dense_section FROM j JOIN (SELECT book_id, chapter_no, section_no, dense_rank() OVER (PARTITION BY book_id ORDER BY chapter_no) AS dense_chapter, row_number() OVER (PARTITION BY book_id, chapter_no ORDER BY section_no) AS dense_section FROM t) d USING (book_id, chapter_no, section_no)) WHERE {_strip('line')} <> '' GROUP BY ALL
        UNION ALL SELECT book_id, 0, 0, '前言', '前言', 1, 20 FROM zh""",
    "page_document": f"WITH {CHUNKS}, l AS (SELECT collection, coalesce(page_number, 0) AS page, unnest(string_split(content, chr(10))) AS line FROM chunks) SELECT collection, page, count(*) + 1 AS lines, (sum(length(line)) + any_value(length('#### 第' || page || '页')))::BIGINT AS chars, '#### 第' || page || '页' AS heading FROM l GROUP BY collection, page",
    "message_roles": "WITH a AS (SELECT DISTINCT query_id, search_type FROM query_log), r AS (SELECT 'human' AS kind FROM a UNION ALL SELECT 'tool' FROM a WHERE search_type IS NOT NULL UNION ALL SELECT 'note' FROM a WHERE search_type IS NOT NULL UNION ALL SELECT 'ai' FROM (SELECT DISTINCT query_id FROM responses WHERE answer IS NOT NULL)) SELECT kind, CASE kind WHEN 'human' THEN 'user' WHEN 'ai' THEN 'assistant' WHEN 'tool' THEN 'tool' ELSE 'user' END AS role, count(*) AS messages FROM r GROUP BY kind",
    "need_search": f"WITH {A._LOG}, x AS (SELECT query_id, CASE WHEN {any_of_sql('lower(question)', L.QUERY_MEDICAL)} THEN 'medical' WHEN {any_of_sql('lower(question)', L.COMPARISON)} THEN 'comparison' ELSE 'general' END AS query_type, {any_of_sql('question', L.KEY_ENTITIES)} AS e FROM log) SELECT DISTINCT query_id, query_type, CASE WHEN query_type <> 'general' OR e THEN 'use_tools' ELSE 'direct_response' END AS route FROM x",
    "chapter_queries": f"""WITH {QUESTION_HITS}, {_BT}, q0 AS (SELECT DISTINCT query_id, question FROM qh), {A._FALL.replace('FROM log', 'FROM q0')},
        x AS (SELECT fall.query_id, coalesce({contained_sql('question', L.KEY_ENTITIES)}[1], k[1]) AS e, infos[1].chapter AS c, infos[1].section AS s FROM fall JOIN bt USING (query_id)),
        y AS (SELECT query_id, [e, '第.*节 ' || e] || CASE WHEN c <> '' AND s <> '' THEN [c || ' ' || s || ' ' || e, c || ' ' || e, s || ' ' || e] WHEN s <> '' THEN [s || ' ' || e] WHEN c <> '' THEN [c || ' ' || e] ELSE [] END AS ts FROM x)
        SELECT query_id, (generate_subscripts(ts, 1) - 1)::INTEGER AS variant, unnest(ts) AS search_text FROM y""",
    "decomposed": f"WITH {A._LOG}, x AS (SELECT query_id, {A._SUFFIX} AS suffix, {contained_sql('question', _ENTITIES)} AS es FROM log), y AS (SELECT query_id, suffix, (generate_subscripts(es, 1) - 1)::INTEGER AS entity_no, unnest(es) AS entity FROM x) SELECT query_id, entity_no, entity, entity || CASE WHEN entity IN ({', '.join(quoted(e) for e in _DISEASES)}) THEN suffix ELSE ' 图像特征' END AS search_text FROM y",
    "merged_entities": f"WITH {QUESTION_HITS}, x AS (SELECT query_id, hit_id, hit_rank, content, {contained_sql('question', _ENTITIES)} AS es FROM qh), y AS (SELECT query_id, hit_id, hit_rank, content, generate_subscripts(es, 1) AS n, unnest(es) AS entity FROM x) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY n, hit_rank, hit_id) AS position, entity, hit_id FROM y WHERE contains(content, entity)",
    "query_boost": f"WITH {A._LOG} SELECT DISTINCT query_id, CASE " + " ".join(f"WHEN {any_of_sql('lower(question)', lex)} THEN {w}::DOUBLE" for lex, w in _TOPICS) + " ELSE 1.0::DOUBLE END AS boost FROM log",
    "chapter_matching": f"""WITH {QUESTION_HITS}, {_BT}, x AS (SELECT qh.*, infos, ({_KEYW} || {contained_sql('question', L.CHAPTER_PHRASES)}) AS ks, {contained_sql('question', _ENTITIES)} AS es FROM qh JOIN bt USING (query_id))
        SELECT hit_id, least(len(list_filter(ks, lambda k: contains(chapter_title, k) OR contains(section_title, k))) * 50.0::DOUBLE + {_scan_sql()} + len(list_filter(es, lambda e: contains(lower(chapter_title), lower(e)))) * 40.0::DOUBLE + len(list_filter(es, lambda e: contains(lower(section_title), lower(e)))) * 50.0::DOUBLE, 150.0::DOUBLE) AS matching FROM x""",
    "mapped_ids": f"WITH {E._RESULTS}, u AS (SELECT question_id, method, coalesce(expected_chunk_ids, []) AS expected, generate_subscripts(retrieved_chunk_ids, 1) AS place, unnest(retrieved_chunk_ids) AS id FROM res) SELECT DISTINCT question_id, method, place::INTEGER AS place, CASE WHEN list_contains(expected, id) THEN id WHEN regexp_matches(id, '^chunk_[0-9]+$') THEN format('doc_{{:04d}}', CAST(regexp_extract(id, '[0-9]+') AS BIGINT)) ELSE format('doc_{{:04d}}', place) END AS mapped_id FROM u",
    "concepts_by_category": "WITH u AS (SELECT DISTINCT coalesce(disease_category, '') AS category, unnest(related_concepts) AS concept FROM questions) SELECT category, count(*) AS concepts, string_agg(concept, '|' ORDER BY concept) AS names FROM u WHERE concept IS NOT NULL GROUP BY category",
    "context_relevancy": f"WITH {QUESTION_HITS}, x AS (SELECT *, list_distinct({words_sql('lower(question)')}) AS w FROM qh) SELECT query_id, round(avg(least(score, 1.0) * 0.7::DOUBLE + CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: contains(lower(content), x)))::DOUBLE / len(w) ELSE 0.0 END * 0.3::DOUBLE) + 1e-9::DOUBLE, 6) AS relevancy, count(*) AS hits FROM x GROUP BY query_id",
    "difficulty_split": "WITH q AS (SELECT DISTINCT id, question_type FROM questions WHERE id IS NOT NULL), r AS (SELECT question_type, count(*) OVER (PARTITION BY question_type) AS n, row_number() OVER (PARTITION BY question_type ORDER BY md5(id), id) AS nth, CASE question_type " + " ".join(f"WHEN '{k}' THEN {a}::DOUBLE" for k, (a, _) in _SPLIT.items()) + " ELSE 0.6::DOUBLE END AS a, CASE question_type " + " ".join(f"WHEN '{k}' THEN {b}::DOUBLE" for k, (_, b) in _SPLIT.items()) + " ELSE 0.3::DOUBLE END AS b FROM q) SELECT question_type, CASE WHEN nth <= floor(n * a + 1e-9) THEN 'basic' WHEN nth <= floor(n * a + 1e-9) + floor(n * b + 1e-9) THEN 'medium' ELSE 'hard' END AS level, count(*) AS questions FROM r GROUP BY ALL",
    "type_quotas": "WITH c AS (SELECT question_type, count(*) AS have FROM (SELECT DISTINCT id, coalesce(question_type, '') AS question_type FROM questions) GROUP BY question_type) SELECT question_type, have, floor((SELECT sum(have) FROM c) * CASE question_type " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in _QUOTAS.items()) + " ELSE 0.0::DOUBLE END + 1e-9)::BIGINT AS wanted FROM c",
    "shuffled_ids": "SELECT id, format('med_q_{:04d}', row_number() OVER (ORDER BY md5(id), id)) AS new_id FROM (SELECT DISTINCT id FROM questions WHERE id IS NOT NULL)",
    "prompt_forms": "WITH q AS (SELECT DISTINCT id, question_type, difficulty, coalesce(expected_chunk_ids, []) AS ids FROM questions) SELECT DISTINCT id, CASE WHEN question_type IN ('differential', 'differential_diagnosis', 'case', 'case_analysis') AND difficulty IN ('medium', 'hard') THEN 'several' ELSE 'single' END AS form, array_to_string(ids[1:4], '|') AS ids FROM q",
}
