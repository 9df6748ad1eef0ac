"""Understanding and rewriting of questions, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import lexicons as L
from quillspark.functions.text import any_of, contained


def query_type(question: Column) -> Column:
    q = F.lower(question)
    return F.when(any_of(q, L.QUERY_MEDICAL), "medical").when(any_of(q, L.COMPARISON), "comparison").otherwise("general")


def entities(question: Column, lexicon: list[str] = L.QUESTION_ENTITIES) -> Column:
    """Entities longest first; a found one is taken out, so that its parts are not found again."""
    ordered = sorted(lexicon, key=lambda w: -len(w))
    start = F.struct(question.alias("rest"), F.array().cast("array<string>").alias("found"))

    def step(acc: Column, e: Column) -> Column:
        hit = F.contains(acc["rest"], e)
        return F.struct(F.when(hit, F.replace(acc["rest"], e, F.lit(""))).otherwise(acc["rest"]).alias("rest"), F.when(hit, F.array_append(acc["found"], e)).otherwise(acc["found"]).alias("found"))

    return F.aggregate(F.array(*[F.lit(e) for e in ordered]), start, step)["found"]


def without_stop_phrases(question: Column) -> Column:
    cut = reduce(lambda acc, w: F.replace(acc, F.lit(w), F.lit("")), L.STOP_PHRASES, question)
    return F.trim(F.regexp_replace(cut, r"\s+", " "))


def search_keywords(question: Column) -> Column:
    """Known entities, or the question without stop phrases."""
    found = F.array_join(contained(F.lower(question), L.SEARCH_ENTITIES), " ")
    return F.when(found != "", found).otherwise(without_stop_phrases(question))


def fallback_keywords(question: Column, most: int = 6) -> Column:
    """Latin words and Han runs of two or more, the first spelling of each, without stop words; else the first 8 characters."""
    raw = F.regexp_extract_all(question, F.lit(r"[A-Za-z0-9]+|[一-鿿]{2,}"), F.lit(0))
    kept = F.filter(raw, lambda w: ~F.lower(w).isin(L.KEYWORD_STOPS))
    firsts = F.filter(kept, lambda w, i: F.array_position(F.transform(kept, F.lower), F.lower(w)) == i + 1)
    return F.when(F.size(firsts) > 0, F.slice(firsts, 1, most)).otherwise(F.array(F.substring(question, 1, 8)))


def chapter_keywords(question: Column) -> Column:
    numbers = F.concat(*[F.regexp_extract_all(question, F.lit(p), F.lit(0)) for p in ("第[一二三四五六七八九十]+章", "第[一二三四五六七八九十]+节", "第[0-9]+章", "第[0-9]+节")])
    return F.concat(numbers, contained(question, L.CHAPTER_PHRASES))


def expanded(question: Column) -> Column:
    """The question with the synonyms of its head words."""
    out = question
    for head, synonyms in L.SYNONYMS.items():
        addition = " OR (" + " OR ".join(f'"{s}"' for s in synonyms) + ")"
        out = F.concat(out, F.when(F.contains(question, F.lit(head)), addition).otherwise(""))
    return out


def variants(question: Column) -> Column:
    """Up to three search texts: the question, a section pattern and a topic suffix of its first entity."""
    first = F.element_at(contained(question, L.KEY_ENTITIES), 1)
    suffix = F.when(any_of(question, ["图像", "特征"]), " 细胞形态 结构特征").when(any_of(question, ["病理", "诊断"]), " 病理特征 诊断要点").otherwise(" 图像特征 细胞学表现")
    return F.when(F.size(contained(question, L.KEY_ENTITIES)) > 0, F.array(question, F.concat(F.lit("第.*节 "), first), F.concat(first, suffix))).otherwise(F.array(question))


def refined(question: Column, strategy: Column) -> Column:
    """The search text of the next round under an optimisation strategy."""
    k = fallback_keywords(question)
    return (
        F.when(strategy == "broaden_search", F.concat(question, F.lit(" 特征 表现 诊断")))
        .when(strategy == "refine_keywords", F.array_join(F.slice(k, 1, 3), " "))
        .when(strategy == "target_descriptive", F.concat(question, F.lit(" 详细描述 细胞形态 组织结构")))
        .when(strategy == "target_titles", F.concat(F.element_at(k, 1), F.lit(" 章节 标题")))
        .when(strategy == "adjust_weights", F.concat(F.array_join(F.slice(k, 1, 2), " "), F.lit(" 病理特征 显微镜下表现")))
        .otherwise(question)
    )


def has_precise_term(question: Column) -> Column:
    return any_of(F.upper(question), L.PRECISE_TERMS) | any_of(question, L.PRECISE_TERMS)
