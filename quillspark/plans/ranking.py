"""Scoring features over all hits of the logged questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import lexicons as L
from quillspark.functions.text import any_of_sql, contained_sql, matches_sql, words_sql
from quillspark.operators import ranking as R
from quillspark.plans.common import QUESTION_HITS, question_hits


def _columns() -> tuple[F.Column, F.Column, F.Column, F.Column, F.Column]:
    """Question, chapter title, section title, content, and both titles together."""
    return F.col("question"), F.col("chapter_title"), F.col("section_title"), F.col("content"), F.concat_ws(" ", "chapter_title", "section_title")


def _scored(spark: SparkSession, folder: str, **columns: F.Column) -> DataFrame:
    return question_hits(spark, folder).select("hit_id", *[(F.round(c + TIE, _ROUNDED[n]) if n in _ROUNDED else c).alias(n) for n, c in columns.items()])


#: Decides ties in the last digit alike in both engines.
TIE = 1e-9
_ROUNDED = {"title_score": 6, "confidence": 6, "relevance": 6, "combined": 4, "quality": 6, "image": 6, "boosted": 6}


def title_priority_v1(spark: SparkSession, folder: str) -> DataFrame:
    q, chapter, section, _, _ = _columns()
    return _scored(spark, folder, title_score=R.title_priority(q, chapter, section))


def title_priority_v2(spark: SparkSession, folder: str) -> DataFrame:
    q, chapter, section, _, _ = _columns()
    return _scored(spark, folder, title_score=R.title_priority_exact(q, chapter, section))


def content_type_v1(spark: SparkSession, folder: str) -> DataFrame:
    _, _, _, content, titles = _columns()
    kind, confidence = R.content_class(content, titles)
    return _scored(spark, folder, content_type=kind, confidence=confidence)


def content_type_v2(spark: SparkSession, folder: str) -> DataFrame:
    _, _, _, content, titles = _columns()
    kind, confidence, descriptive = R.description(content, titles)
    return _scored(spark, folder, content_type=kind, confidence=confidence, is_descriptive=descriptive)


def term_density(spark: SparkSession, folder: str) -> DataFrame:
    q, _, _, content, _ = _columns()
    return _scored(spark, folder, relevance=R.term_density(q, content))


def concept_level(spark: SparkSession, folder: str) -> DataFrame:
    q, _, _, content, _ = _columns()
    kind, relevance = R.concept_relevance(q, content)
    return _scored(spark, folder, query_kind=kind, relevance=relevance)


def combined_v1(spark: SparkSession, folder: str) -> DataFrame:
    """First combination of base, title, content and concept scores; ranks within each query by it."""
    q, chapter, section, content, titles = _columns()
    _, confidence = R.content_class(content, titles)
    _, relevance = R.concept_relevance(q, content)
    return _scored(spark, folder, combined=R.tiered(F.col("score"), R.title_priority(q, chapter, section), confidence, relevance, R.FIRST_TIERS, (5.0, 0.5)))


def combined_v2(spark: SparkSession, folder: str) -> DataFrame:
    q, chapter, section, content, titles = _columns()
    _, confidence, _ = R.description(content, titles)
    return _scored(spark, folder, combined=R.tiered(F.col("score"), R.title_priority_exact(q, chapter, section), confidence, R.term_density(q, content), R.SECOND_TIERS, (8.0, 2.0)))


def content_quality(spark: SparkSession, folder: str) -> DataFrame:
    _, _, _, content, _ = _columns()
    return _scored(spark, folder, quality=R.quality(content), image=R.image_relevance(content), is_high_quality=R.is_high_quality(content))


def chapter_boost(spark: SparkSession, folder: str) -> DataFrame:
    q, chapter, section, content, _ = _columns()
    return _scored(spark, folder, boosted=R.chapter_boost(F.col("score"), q, content, chapter, section))


def relevance_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Scores normalised by the best of their query, and their level."""
    hits = question_hits(spark, folder).withColumn("highest", F.max("score").over(Window.partitionBy("query_id")))
    norm = F.round(R.relevance(F.col("score"), F.col("highest")), 6)
    return hits.select("hit_id", norm.alias("normalised"), R.level(norm).alias("level"))


def search_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of each query's hits: how many, how relevant, descriptive, titled and high-scored they are, and the next strategy."""
    _, chapter, section, content, _ = _columns()
    words = F.filter(F.split(F.lower("question"), r"\s+"), lambda w: w != "")
    hits = question_hits(spark, folder)
    share = lambda c: F.avg(c.cast("double"))
    per = hits.groupBy("query_id").agg(
        F.count("*").alias("hits"),
        share(F.exists(words, lambda w: F.contains(F.lower("content"), w))).alias("relevant"),
        share(F.length("content") > 200).alias("descriptive"),
        share((chapter != "") | (section != "")).alias("titled"),
        F.avg("score").alias("mean_score"),
    )
    quality = F.when(F.col("hits") >= 5, 0.15).when(F.col("hits") >= 3, 0.10).otherwise(0.05) + F.col("relevant") * 0.25 + F.col("descriptive") * 0.35 + F.col("titled") * 0.15 + F.when(F.col("mean_score") > 0.5, 0.10).when(F.col("mean_score") > 0.3, 0.05).otherwise(0.0)
    strategy = F.when(F.col("hits") < 3, "broaden_search").when(F.col("relevant") < 0.5, "refine_keywords").when(F.col("descriptive") < 0.5, "target_descriptive").when(F.col("titled") < 0.5, "target_titles").when(F.col("mean_score") < 0.3, "adjust_weights").otherwise("none")
    return per.select("query_id", "hits", F.round(quality, 6).alias("quality"), F.round(F.least(quality + 0.3, F.lit(0.95)), 6).alias("confidence"), strategy.alias("strategy"))


QUERIES = {f.__name__: f for f in (title_priority_v1, title_priority_v2, content_type_v1, content_type_v2, term_density, concept_level, combined_v1, combined_v2, content_quality, chapter_boost, relevance_levels, search_quality)}

_QW = words_sql("lower(question)")


def _share_sql(title: str) -> str:
    return f"CASE WHEN len({_QW}) > 0 THEN len(list_filter({_QW}, lambda w: contains(lower({title}), w)))::DOUBLE / len({_QW}) ELSE 0.0 END"


_TITLE1 = "least(" + " + ".join(
    [f"CASE WHEN contains(lower({t}), lower(question)) THEN {w}::DOUBLE ELSE {w}::DOUBLE * ({_share_sql(t)}) END" for t, w in (("chapter_title", 10.0), ("section_title", 8.0))]
    + [f"CASE WHEN contains(lower(chapter_title), '{x}') OR contains(lower(section_title), '{x}') THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END" for x in L.TITLE_WORDS]
) + ", 25.0::DOUBLE)"
_TITLE2 = "least(CASE WHEN lower(question) = lower(chapter_title) THEN 50.0 WHEN lower(question) = lower(section_title) THEN 40.0 ELSE 0.0 END + " + " + ".join(
    [f"CASE WHEN contains(lower({t}), lower(question)) THEN {w} ELSE 0.0 END + len(list_filter({_QW}, lambda w: contains(lower({t}), w))) * ({w} * 0.3::DOUBLE)" for t, w in (("chapter_title", 25.0), ("section_title", 20.0))]
    + [f"CASE WHEN contains(lower(chapter_title), '{x}') OR contains(lower(section_title), '{x}') THEN 1.0 ELSE 0.0 END" for x in L.TITLE_TERMS]
) + ", 50.0)"
_BT = "lower(chapter_title || ' ' || section_title)"
_COUNTS = ", ".join(f"{matches_sql('lower(content)', lex)} AS c{i}" for i, lex in enumerate((L.ROSE, L.DIAGNOSTIC, L.TREATMENT, L.CASE)))
_TITLED = [any_of_sql(_BT, lex) for lex in (L.ROSE, L.DIAGNOSTIC, L.TREATMENT, L.CASE)]
_NAMES = ("rose_technology", "diagnostic_criteria", "treatment_guidelines", "case_study")
_K1 = "CASE " + " ".join(f"WHEN {t} THEN '{n}'" for t, n in zip(_TITLED, _NAMES, strict=True)) + " " + " ".join(f"WHEN c{i} = greatest(c0, c1, c2, c3) AND c{i} >= 2 THEN '{n}'" for i, n in enumerate(_NAMES)) + " ELSE 'general' END"
_F1 = "CASE " + " ".join(f"WHEN {t} THEN {v}" for t, v in zip(_TITLED, (0.9, 0.8, 0.8, 0.7), strict=True)) + " " + " ".join(f"WHEN c{i} = greatest(c0, c1, c2, c3) AND c{i} >= 2 THEN least({cap}::DOUBLE, c{i} * {step}::DOUBLE)" for i, (cap, step) in enumerate(((0.8, 0.2), (0.7, 0.15), (0.7, 0.15), (0.6, 0.15)))) + " ELSE 0.0 END"
_DMF = f"{matches_sql('lower(content)', L.DESCRIPTIVE)} AS d, {matches_sql('lower(content)', L.MEDICAL)} AS m, {matches_sql('lower(content)', L.FIGURE)} AS f, {any_of_sql(_BT, L.DESCRIPTIVE_TITLES)} AS titled"
_K2 = "CASE WHEN d >= 3 AND m >= 2 THEN 'descriptive_medical' WHEN d >= 2 THEN 'descriptive' WHEN m >= 3 THEN 'medical' WHEN titled THEN 'descriptive_medical' ELSE 'general' END"
_F2 = "(CASE WHEN d >= 3 AND m >= 2 THEN least(0.9::DOUBLE, 0.3::DOUBLE + d * 0.1::DOUBLE + m * 0.05::DOUBLE) WHEN d >= 2 THEN least(0.7::DOUBLE, 0.2::DOUBLE + d * 0.08::DOUBLE) WHEN m >= 3 THEN least(0.6::DOUBLE, m * 0.08::DOUBLE) WHEN titled THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END * CASE WHEN f >= 2 AND length(content) < 200 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END)"
_I2 = "((d >= 2 OR titled) AND NOT (f >= 2 AND length(content) < 200))"
_UQ = f"list_distinct({_QW})"
_CW = words_sql("lower(content)")
_DENSITY = f"((CASE WHEN len({_UQ}) > 0 THEN len(list_filter({_UQ}, lambda w: contains(lower(content), w)))::DOUBLE / len({_UQ}) ELSE 0.0 END) * 0.6::DOUBLE + least((CASE WHEN len({_CW}) > 0 THEN ({matches_sql('lower(content)', L.BASIC_TERMS)} + {matches_sql('lower(content)', L.PROFESSIONAL_TERMS)} * 2.0::DOUBLE) / len({_CW}) * 100 ELSE 0.0 END) / 5.0::DOUBLE, 1.0::DOUBLE) * 0.4::DOUBLE)"
_BASIC, _SPEC = L.BASIC_CONCEPTS + L.ROSE_BASIC, L.SUBTYPES + L.ROSE_SPECIFIC
_CB, _CS = matches_sql("lower(content)", _BASIC), matches_sql("lower(content)", _SPEC)
_QK = f"CASE WHEN {any_of_sql('lower(question)', _SPEC)} THEN 'specific' WHEN {any_of_sql('lower(question)', _BASIC)} THEN 'basic' ELSE 'general' END"
_QR = f"CASE WHEN {any_of_sql('lower(question)', _SPEC)} THEN {_CS} * 2.0::DOUBLE + {_CB} * 0.5::DOUBLE WHEN {any_of_sql('lower(question)', _BASIC)} THEN {_CB} * 1.5::DOUBLE + {_CS} * 1.0::DOUBLE ELSE ({_CB} + {_CS}) * 1.0::DOUBLE END"


def _tiers_sql(tiers: tuple, factors: tuple[float, float]) -> str:
    value = lambda w: f"score * {w[0]}::DOUBLE + ts * {w[1]}::DOUBLE + cf * {factors[0]}::DOUBLE * {w[2]}::DOUBLE + rl * {factors[1]}::DOUBLE * {w[3]}::DOUBLE"
    return f"CASE WHEN score >= 50 THEN {value(tiers[0][1])} WHEN score >= 20 THEN {value(tiers[1][1])} ELSE {value(tiers[2][1])} END"


_WITH = f"WITH {QUESTION_HITS}"
_NUM = "第[一二三四五六七八九十]+[节章]|第[0-9]+[节章]"
_HQ = f"(length(content) >= 50 AND {matches_sql('content', L.QUALITY_INDICATORS)} >= 2 AND {matches_sql('content', ['。', '；', '：'])} >= 1)"
_QUALITY = f"CASE WHEN content = '' THEN 0.0 ELSE least(least({matches_sql('lower(content)', L.QUALITY_TERMS)} * 0.1::DOUBLE, 0.5::DOUBLE) + least({matches_sql('lower(content)', L.IMAGE_MARKS)} * 0.15::DOUBLE, 0.3::DOUBLE) + CASE WHEN {any_of_sql('lower(content)', ['①', '1.', '（1）'])} THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END, 1.0::DOUBLE) END"
_IMAGE = f"CASE WHEN content = '' THEN 0.0 ELSE least({matches_sql('lower(content)', L.IMAGE_WORDS)} * 0.2::DOUBLE + {matches_sql('lower(content)', L.FEATURE_WORDS)} * 0.15::DOUBLE + least({matches_sql('lower(content)', L.MORPHOLOGY)} * 0.1::DOUBLE, 0.4::DOUBLE), 1.0::DOUBLE) END"
_LEVEL = "CASE WHEN normalised >= 0.9 THEN 'very high' WHEN normalised >= 0.8 THEN 'high' WHEN normalised >= 0.6 THEN 'medium' WHEN normalised >= 0.4 THEN 'low' ELSE 'very low' END"
SQL = {
    "title_priority_v1": f"{_WITH} SELECT hit_id, round({_TITLE1} + 1e-9::DOUBLE, 6) AS title_score FROM qh",
    "title_priority_v2": f"{_WITH} SELECT hit_id, round({_TITLE2} + 1e-9::DOUBLE, 6) AS title_score FROM qh",
    "content_type_v1": f"{_WITH}, x AS (SELECT *, {_COUNTS} FROM qh) SELECT hit_id, {_K1} AS content_type, round({_F1} + 1e-9::DOUBLE, 6) AS confidence FROM x",
    "content_type_v2": f"{_WITH}, x AS (SELECT *, {_DMF} FROM qh) SELECT hit_id, {_K2} AS content_type, round({_F2} + 1e-9::DOUBLE, 6) AS confidence, {_I2} AS is_descriptive FROM x",
    "term_density": f"{_WITH} SELECT hit_id, round({_DENSITY} + 1e-9::DOUBLE, 6) AS relevance FROM qh",
    "concept_level": f"{_WITH} SELECT hit_id, {_QK} AS query_kind, round({_QR} + 1e-9::DOUBLE, 6) AS relevance FROM qh",
    "combined_v1": f"{_WITH}, x AS (SELECT *, {_COUNTS} FROM qh), y AS (SELECT hit_id, score, {_TITLE1} AS ts, {_F1} AS cf, {_QR} AS rl FROM x) SELECT hit_id, round({_tiers_sql(R.FIRST_TIERS, (5.0, 0.5))} + 1e-9::DOUBLE, 4) AS combined FROM y",
    "combined_v2": f"{_WITH}, x AS (SELECT *, {_DMF} FROM qh), y AS (SELECT hit_id, score, {_TITLE2} AS ts, {_F2} AS cf, {_DENSITY} AS rl FROM x) SELECT hit_id, round({_tiers_sql(R.SECOND_TIERS, (8.0, 2.0))} + 1e-9::DOUBLE, 4) AS combined FROM y",
    "content_quality": f"{_WITH} SELECT hit_id, round({_QUALITY} + 1e-9::DOUBLE, 6) AS quality, round({_IMAGE} + 1e-9::DOUBLE, 6) AS image, {_HQ} AS is_high_quality FROM qh",
    "chapter_boost": f"{_WITH}, x AS (SELECT *, {contained_sql('question', L.KEY_ENTITIES)} AS es FROM qh) SELECT hit_id, round(least(score + (CASE WHEN regexp_matches(content, '{_NUM}') OR regexp_matches(chapter_title, '{_NUM}') OR regexp_matches(section_title, '{_NUM}') THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN len(list_filter(es, lambda e: contains(chapter_title, e) OR contains(section_title, e))) > 0 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN {_HQ} THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END), 1.0::DOUBLE) + 1e-9::DOUBLE, 6) AS boosted FROM x",
    "relevance_levels": f"{_WITH}, x AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS highest FROM qh), y AS (SELECT hit_id, round(CASE WHEN score <= 1 THEN score WHEN highest > 0 THEN least(score / highest, 1.0) WHEN score <= 10 THEN score / 10.0 WHEN score <= 100 THEN 0.9 + (score - 10.0) / 900.0 ELSE least(0.95 + log10(score) / 100.0, 1.0) END, 6) AS normalised FROM x) SELECT *, {_LEVEL} AS level FROM y",
    "search_quality": rf"""{_WITH}, w AS (SELECT *, list_filter(string_split_regex(lower(question), '\s+'), lambda w: w <> '') AS ws FROM qh),
        p AS (SELECT query_id, count(*) AS hits, avg(CASE WHEN len(list_filter(ws, lambda w: contains(lower(content), w))) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS relevant, avg(CASE WHEN length(content) > 200 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS descriptive,
              avg(CASE WHEN chapter_title <> '' OR section_title <> '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS titled, avg(score) AS mean_score FROM w GROUP BY query_id),
        q AS (SELECT *, CASE WHEN hits >= 5 THEN 0.15::DOUBLE WHEN hits >= 3 THEN 0.10::DOUBLE ELSE 0.05::DOUBLE END + relevant * 0.25::DOUBLE + descriptive * 0.35::DOUBLE + titled * 0.15::DOUBLE + CASE WHEN mean_score > 0.5 THEN 0.10::DOUBLE WHEN mean_score > 0.3 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END AS quality FROM p)
        SELECT query_id, hits, round(quality, 6) AS quality, round(least(quality + 0.3::DOUBLE, 0.95::DOUBLE), 6) AS confidence, CASE WHEN hits < 3 THEN 'broaden_search' WHEN relevant < 0.5 THEN 'refine_keywords' WHEN descriptive < 0.5 THEN 'target_descriptive' WHEN titled < 0.5 THEN 'target_titles' WHEN mean_score < 0.3 THEN 'adjust_weights' ELSE 'none' END AS strategy FROM q""",
}
