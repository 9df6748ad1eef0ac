"""Question understanding over the query log, and sessions and statistics of serving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import lexicons as L
from quillspark.functions.text import any_of_sql, contained_sql, quoted
from quillspark.operators import questions as Q
from quillspark.operators.evaluation import with_quantiles
from quillspark.sources.tables import table


def _log(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "query_log").where("question IS NOT NULL").select("query_id", "question").distinct()


_LOG = "log AS (SELECT DISTINCT query_id, question FROM query_log WHERE question IS NOT NULL)"


def query_type(spark: SparkSession, folder: str) -> DataFrame:
    return _log(spark, folder).select("query_id", Q.query_type(F.col("question")).alias("query_type"), Q.has_precise_term(F.col("question")).alias("precise"))


def query_entities(spark: SparkSession, folder: str) -> DataFrame:
    found = Q.entities(F.col("question"))
    kind = F.when(Q.any_of(F.lower("question"), L.COMPARISON_WIDE), "comparison").when(F.size(found) > 1, "multi_entity").otherwise("single")
    return _log(spark, folder).select("query_id", F.array_join(found, "|").alias("entities"), kind.alias("kind"))


def query_keywords(spark: SparkSession, folder: str) -> DataFrame:
    return _log(spark, folder).select("query_id", Q.search_keywords(F.col("question")).alias("keywords"), Q.without_stop_phrases(F.col("question")).alias("cleaned"))


def fallback_keywords(spark: SparkSession, folder: str) -> DataFrame:
    return _log(spark, folder).select("query_id", F.array_join(Q.fallback_keywords(F.col("question")), "|").alias("keywords"))


def query_variants(spark: SparkSession, folder: str) -> DataFrame:
    rows = _log(spark, folder).select("query_id", F.posexplode(Q.variants(F.col("question"))).alias("variant", "search_text"))
    return rows.select("query_id", "variant", "search_text")


def synonym_expansion(spark: SparkSession, folder: str) -> DataFrame:
    return _log(spark, folder).select("query_id", Q.expanded(F.col("question")).alias("expanded"))


def chapter_words(spark: SparkSession, folder: str) -> DataFrame:
    texts = table(spark, folder, "search_results").select("doc_id", F.concat_ws(" ", F.coalesce("chapter_title", F.lit("")), F.coalesce("section_title", F.lit(""))).alias("t")).distinct()
    return texts.select("doc_id", F.array_join(Q.chapter_keywords(F.col("t")), "|").alias("words"))


STRATEGIES = ("broaden_search", "refine_keywords", "target_descriptive", "target_titles", "adjust_weights", "none")


def refinements(spark: SparkSession, folder: str) -> DataFrame:
    rows = _log(spark, folder).withColumn("strategy", F.explode(F.array(*[F.lit(s) for s in STRATEGIES])))
    return rows.select("query_id", "strategy", Q.refined(F.col("question"), F.col("strategy")).alias("search_text"))


def suggestions(spark: SparkSession, folder: str) -> DataFrame:
    """Known phrases that contain a keyword of the question set, the first five in their order."""
    words = table(spark, folder, "questions").select(F.explode("keywords").alias("word")).where("word IS NOT NULL AND word != ''").distinct()
    found = F.filter(F.array(*[F.lit(s) for s in L.SUGGESTIONS]), lambda s: F.contains(F.lower(s), F.lower("word")))
    return words.select("word", F.array_join(F.slice(found, 1, 5), "|").alias("suggestions"))


def session_history(spark: SparkSession, folder: str) -> DataFrame:
    """Per session: distinct queries in order of asking, users, first and last time."""
    log = table(spark, folder, "query_log").where("session_id IS NOT NULL").groupBy("session_id", "query_id").agg(F.min("asked_at").alias("asked_at"), F.max("user_id").alias("user_id"))
    ordered = F.array_sort(F.collect_list(F.struct("asked_at", "query_id")))
    return log.groupBy("session_id").agg(F.array_join(F.transform(ordered, lambda x: x["query_id"]), ",").alias("history"), F.count("*").alias("queries"), F.countDistinct("user_id").alias("users"), F.unix_micros(F.min("asked_at")).alias("first_us"), F.unix_micros(F.max("asked_at")).alias("last_us"))


def session_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Visits of each user: a pause of more than 30 minutes begins a new one."""
    log = table(spark, folder, "query_log").where("user_id IS NOT NULL AND asked_at IS NOT NULL").groupBy("user_id", "query_id").agg(F.min("asked_at").alias("asked_at"))
    # within a day first, then each day's first question against the last one before it: a user with very many questions is no hot group
    log = log.withColumn("day", F.to_date("asked_at"))
    w = Window.partitionBy("user_id", "day").orderBy("asked_at", "query_id")
    seconds = F.unix_timestamp("asked_at")
    gaps = log.select("user_id", "day", seconds.alias("at"), (seconds - F.lag(seconds).over(w)).alias("gap"))
    days = gaps.groupBy("user_id", "day").agg(F.count("*").alias("queries"), F.count_if(F.col("gap") > 1800).alias("pauses"), F.min("at").alias("first"), F.max("at").alias("last"))
    pause = F.col("first") - F.lag("last").over(Window.partitionBy("user_id").orderBy("day"))
    days = days.withColumn("opens", (pause.isNull() | (pause > 1800)).cast("int"))
    return days.groupBy("user_id").agg(F.sum(F.col("pauses") + F.col("opens")).alias("visits"), F.sum("queries").alias("queries"))


def model_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Per model: answers, mean, median and 95th percentile of the response time, mean confidence."""
    rows = table(spark, folder, "responses").select("query_id", "model_used", "response_time", "confidence").distinct()
    grouped = rows.groupBy("model_used").agg(F.count("*").alias("answers"), F.round(F.avg("response_time"), 6).alias("mean_time"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))
    return with_quantiles(grouped, rows, ["model_used"], "response_time", {"median_time": 0.5, "p95_time": 0.95})


def answer_retrieval(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that answers used and searches they issued; how often a document was used."""
    rows = table(spark, folder, "responses").select("query_id", F.explode("retrieved_documents").alias("d")).select("query_id", F.col("d.doc_id").alias("doc_id"), F.col("d.score").alias("score")).distinct()
    return rows.groupBy("doc_id").agg(F.countDistinct("query_id").alias("answers"), F.round(F.max("score"), 6).alias("best_score"))


def queries_per_day(spark: SparkSession, folder: str) -> DataFrame:
    log = table(spark, folder, "query_log").where("asked_at IS NOT NULL").select("query_id", "asked_at", "search_type").distinct()
    return log.groupBy(F.date_trunc("day", "asked_at").cast("date").alias("day"), "search_type").agg(F.countDistinct("query_id").alias("queries"))


def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly counts and means of the event stream, as the streaming form of it gives them."""
    e = table(spark, folder, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.avg("value"), 4).alias("mean_value")).select(F.col("w.start").alias("hour"), "event_type", "events", "mean_value")


QUERIES = {f.__name__: f for f in (query_type, query_entities, query_keywords, fallback_keywords, query_variants, synonym_expansion, chapter_words, refinements, suggestions, session_history, session_gaps, model_stats, answer_retrieval, queries_per_day, event_windows)}


def _cleaned_sql(text: str) -> str:
    for w in L.STOP_PHRASES:
        text = f"replace({text}, {quoted(w)}, '')"
    return rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"


_STOPS = "[" + ", ".join(quoted(w) for w in L.KEYWORD_STOPS) + "]"
_FALL = f"""raw AS (SELECT query_id, question, list_filter(regexp_extract_all(question, '[A-Za-z0-9]+|[一-鿿]{{2,}}'), lambda w: NOT list_contains({_STOPS}, lower(w))) AS r FROM log),
    firsts AS (SELECT query_id, question, list_filter(r, lambda w, i: list_position(list_transform(r, lambda x: lower(x)), lower(w)) = i) AS f FROM raw),
    fall AS (SELECT query_id, question, CASE WHEN len(f) > 0 THEN f[1:6] ELSE [substring(question, 1, 8)] END AS k FROM firsts)"""
_ENT = sorted(L.QUESTION_ENTITIES, key=lambda w: -len(w))


def _entities_sql() -> str:
    """One step for each entity: taken if still there, and cut out of the rest."""
    steps = ["e0 AS (SELECT query_id, question, question AS rest, CAST([] AS VARCHAR[]) AS found FROM log)"]
    for i, e in enumerate(_ENT):
        steps.append(f"e{i + 1} AS (SELECT query_id, question, replace(rest, {quoted(e)}, '') AS rest, CASE WHEN contains(rest, {quoted(e)}) THEN list_append(found, {quoted(e)}) ELSE found END AS found FROM e{i})")
    return ", ".join(steps)


_SUFFIX = f"CASE WHEN {any_of_sql('question', ['图像', '特征'])} THEN ' 细胞形态 结构特征' WHEN {any_of_sql('question', ['病理', '诊断'])} THEN ' 病理特征 诊断要点' ELSE ' 图像特征 细胞学表现' END"
_NUMBERS = " || ".join(f"regexp_extract_all(t, '{p}')" for p in ("第[一二三四五六七八九十]+章", "第[一二三四五六七八九十]+节", "第[0-9]+章", "第[0-9]+节"))
SQL = {
    "query_type": f"WITH {_LOG} SELECT query_id, CASE WHEN {any_of_sql('lower(question)', L.QUERY_MEDICAL)} THEN 'medical' WHEN {any_of_sql('lower(question)', L.COMPARISON)} THEN 'comparison' ELSE 'general' END AS query_type, ({any_of_sql('upper(question)', L.PRECISE_TERMS)} OR {any_of_sql('question', L.PRECISE_TERMS)}) AS precise FROM log",
    "query_entities": f"WITH {_LOG}, {_entities_sql()} SELECT query_id, array_to_string(found, '|') AS entities, CASE WHEN {any_of_sql('lower(question)', L.COMPARISON_WIDE)} THEN 'comparison' WHEN len(found) > 1 THEN 'multi_entity' ELSE 'single' END AS kind FROM e{len(_ENT)}",
    "query_keywords": f"WITH {_LOG}, x AS (SELECT *, array_to_string({contained_sql('lower(question)', L.SEARCH_ENTITIES)}, ' ') AS found, {_cleaned_sql('question')} AS cleaned FROM log) SELECT query_id, CASE WHEN found <> '' THEN found ELSE cleaned END AS keywords, cleaned FROM x",
    "fallback_keywords": f"WITH {_LOG}, {_FALL} SELECT query_id, array_to_string(k, '|') AS keywords FROM fall",
    "query_variants": f"WITH {_LOG}, x AS (SELECT *, {contained_sql('question', L.KEY_ENTITIES)} AS es FROM log), v AS (SELECT query_id, CASE WHEN len(es) > 0 THEN [question, '第.*节 ' || es[1], es[1] || {_SUFFIX}] ELSE [question] END AS vs FROM x) SELECT query_id, (generate_subscripts(vs, 1) - 1)::INTEGER AS variant, unnest(vs) AS search_text FROM v",
    "synonym_expansion": f"WITH {_LOG} SELECT query_id, question" + "".join(f" || CASE WHEN contains(question, {quoted(h)}) THEN {quoted(' OR (' + ' OR '.join(chr(34) + s + chr(34) for s in ss) + ')')} ELSE '' END" for h, ss in L.SYNONYMS.items()) + " AS expanded FROM log",
    "chapter_words": f"WITH x AS (SELECT DISTINCT doc_id, coalesce(chapter_title, '') || ' ' || coalesce(section_title, '') AS t FROM search_results) SELECT doc_id, array_to_string({_NUMBERS} || {contained_sql('t', L.CHAPTER_PHRASES)}, '|') AS words FROM x",
    "refinements": f"WITH {_LOG}, {_FALL}, s AS (SELECT unnest([{', '.join(quoted(x) for x in STRATEGIES)}]) AS strategy) SELECT query_id, strategy, CASE strategy WHEN 'broaden_search' THEN question || ' 特征 表现 诊断' WHEN 'refine_keywords' THEN array_to_string(k[1:3], ' ') WHEN 'target_descriptive' THEN question || ' 详细描述 细胞形态 组织结构' WHEN 'target_titles' THEN k[1] || ' 章节 标题' WHEN 'adjust_weights' THEN array_to_string(k[1:2], ' ') || ' 病理特征 显微镜下表现' ELSE question END AS search_text FROM fall, s",
    "suggestions": f"WITH w AS (SELECT DISTINCT word FROM (SELECT unnest(keywords) AS word FROM questions) WHERE word IS NOT NULL AND word <> '') SELECT word, array_to_string(list_filter([{', '.join(quoted(s) for s in L.SUGGESTIONS)}], lambda s: contains(lower(s), lower(word)))[1:5], '|') AS suggestions FROM w",
    "session_history": "WITH l AS (SELECT session_id, query_id, min(asked_at) AS asked_at, max(user_id) AS user_id FROM query_log WHERE session_id IS NOT NULL GROUP BY session_id, query_id) SELECT session_id, string_agg(query_id, ',' ORDER BY asked_at NULLS FIRST, query_id) AS history, count(*) AS queries, count(DISTINCT user_id) AS users, epoch_us(min(asked_at)) AS first_us, epoch_us(max(asked_at)) AS last_us FROM l GROUP BY session_id",
    "session_gaps": "WITH l AS (SELECT user_id, query_id, min(asked_at) AS asked_at FROM query_log WHERE user_id IS NOT NULL AND asked_at IS NOT NULL GROUP BY user_id, query_id), g AS (SELECT *, floor(epoch(asked_at)) - floor(epoch(lag(asked_at) OVER (PARTITION BY user_id ORDER BY asked_at, query_id))) AS gap FROM l), v AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY asked_at, query_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS visit FROM g) SELECT user_id, max(visit) AS visits, count(*) AS queries FROM v GROUP BY user_id",
    "model_stats": "WITH r AS (SELECT DISTINCT query_id, model_used, response_time, confidence FROM responses) SELECT model_used, count(*) AS answers, round(avg(response_time), 6) AS mean_time, round(median(response_time), 6) AS median_time, round(quantile_cont(response_time, 0.95), 6) AS p95_time, round(avg(confidence), 6) AS mean_confidence FROM r GROUP BY model_used",
    "answer_retrieval": "WITH u AS (SELECT query_id, unnest(retrieved_documents) AS d FROM responses), r AS (SELECT DISTINCT query_id, d.doc_id AS doc_id, d.score AS score FROM u) SELECT doc_id, count(DISTINCT query_id) AS answers, round(max(score), 6) AS best_score FROM r GROUP BY doc_id",
    "queries_per_day": "SELECT date_trunc('day', asked_at)::DATE AS day, search_type, count(DISTINCT query_id) AS queries FROM query_log WHERE asked_at IS NOT NULL GROUP BY ALL",
    "event_windows": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS events, round(avg(value), 4) AS mean_value FROM events GROUP BY ALL",
}
