"""Scoring features of a query and a hit: title match, content type, term density, quality, and their combinations.

Every function maps columns to a column. ``query``, ``chapter``, ``section`` and ``content`` must not be null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import lexicons as L
from quillspark.functions.text import any_of, contained, matches, words


def _share_of_words(query: Column, title: Column) -> Column:
    w = words(F.lower(query))
    return F.when(F.size(w) > 0, F.size(F.filter(w, lambda x: F.contains(F.lower(title), x))) / F.size(w)).otherwise(0.0)


def _inside(entries: Column, text: Column) -> Column:
    return F.filter(entries, lambda x: F.contains(text, x))


def title_priority(query: Column, chapter: Column, section: Column, weights: tuple[float, float] = (10.0, 8.0), cap: float = 25.0) -> Column:
    """Whole query in a title gives its weight, else the share of its words; 2 for each known word in either title."""
    q = F.lower(query)
    total = F.lit(0.0)
    for title, weight in ((chapter, weights[0]), (section, weights[1])):
        t = F.lower(title)
        total = total + F.when(F.contains(t, q), weight).otherwise(weight * _share_of_words(query, title))
    for word in L.TITLE_WORDS:
        total = total + F.when(F.contains(F.lower(chapter), F.lit(word)) | F.contains(F.lower(section), F.lit(word)), 2.0).otherwise(0.0)
    return F.least(total, F.lit(cap))


def title_priority_exact(query: Column, chapter: Column, section: Column, weights: tuple[float, float] = (25.0, 20.0), bonus: float = 5.0, cap: float = 50.0) -> Column:
    """Equality counts twice a weight, containment once, every word of the query in a title three tenths; terms add a fifth of the bonus."""
    q, c, s = F.lower(query), F.lower(chapter), F.lower(section)
    total = F.when(q == c, weights[0] * 2).when(q == s, weights[1] * 2).otherwise(0.0)
    for title, weight in ((c, weights[0]), (s, weights[1])):
        total = total + F.when(F.contains(title, q), weight).otherwise(0.0)
        total = total + F.size(_inside(words(q), title)) * (weight * 0.3)
    for term in L.TITLE_TERMS:
        total = total + F.when(F.contains(c, F.lit(term)) | F.contains(s, F.lit(term)), bonus * 0.2).otherwise(0.0)
    return F.least(total, F.lit(cap))


_CLASSES = (("rose_technology", L.ROSE, 0.9, 0.8, 0.2), ("diagnostic_criteria", L.DIAGNOSTIC, 0.8, 0.7, 0.15), ("treatment_guidelines", L.TREATMENT, 0.8, 0.7, 0.15), ("case_study", L.CASE, 0.7, 0.6, 0.15))


def content_class(content: Column, title: Column) -> tuple[Column, Column]:
    """Class and confidence: by title words first, else by the class with most content words, if at least two."""
    c, t = F.lower(content), F.lower(title)
    counts = [matches(c, lexicon) for _, lexicon, *_ in _CLASSES]
    most = F.greatest(*counts)
    kind, confidence = F.lit("general"), F.lit(0.0)
    for (name, _, _, cap, step), n in list(zip(_CLASSES, counts, strict=True))[::-1]:
        won = (n == most) & (n >= 2)
        kind, confidence = F.when(won, name).otherwise(kind), F.when(won, F.least(F.lit(cap), n * step)).otherwise(confidence)
    for name, lexicon, by_title, *_ in _CLASSES[::-1]:
        hit = any_of(t, lexicon)
        kind, confidence = F.when(hit, name).otherwise(kind), F.when(hit, by_title).otherwise(confidence)
    return kind, confidence


def description(content: Column, title: Column) -> tuple[Column, Column, Column]:
    """Kind, confidence and whether descriptive; short texts that refer to figures lose half and the flag."""
    c = F.lower(content)
    d, m, f = matches(c, L.DESCRIPTIVE), matches(c, L.MEDICAL), matches(c, L.FIGURE)
    titled = any_of(F.lower(title), L.DESCRIPTIVE_TITLES)
    both, some, terms = (d >= 3) & (m >= 2), d >= 2, m >= 3
    kind = F.when(both, "descriptive_medical").when(some, "descriptive").when(terms, "medical").when(titled, "descriptive_medical").otherwise("general")
    confidence = F.when(both, F.least(F.lit(0.9), 0.3 + d * 0.1 + m * 0.05)).when(some, F.least(F.lit(0.7), 0.2 + d * 0.08)).when(terms, F.least(F.lit(0.6), m * 0.08)).when(titled, 0.8).otherwise(0.0)
    figures = (f >= 2) & (F.length(content) < 200)
    return kind, F.when(figures, confidence * 0.5).otherwise(confidence), (both | some | titled) & ~figures


def term_density(query: Column, content: Column) -> Column:
    """Six tenths of the share of query words in the content and four tenths of its capped density of terms."""
    w = F.array_distinct(words(F.lower(query)))
    c = F.lower(content)
    relevance = F.when(F.size(w) > 0, F.size(F.filter(w, lambda x: F.contains(c, x))) / F.size(w)).otherwise(0.0)
    n = F.size(words(c))
    density = F.when(n > 0, (matches(c, L.BASIC_TERMS) + matches(c, L.PROFESSIONAL_TERMS) * 2.0) / n * 100).otherwise(0.0)
    return relevance * 0.6 + F.least(density / 5.0, F.lit(1.0)) * 0.4


def concept_relevance(query: Column, content: Column) -> tuple[Column, Column]:
    """Query type (specific, basic, general) and the weighted count of concept words in the content."""
    q, c = F.lower(query), F.lower(content)
    basic, specific = L.BASIC_CONCEPTS + L.ROSE_BASIC, L.SUBTYPES + L.ROSE_SPECIFIC
    b, s = matches(c, basic), matches(c, specific)
    kind = F.when(any_of(q, specific), "specific").when(any_of(q, basic), "basic").otherwise("general")
    return kind, F.when(kind == "specific", s * 2.0 + b * 0.5).when(kind == "basic", b * 1.5 + s * 1.0).otherwise((b + s) * 1.0)


def tiered(base: Column, title: Column, confidence: Column, relevance: Column, tiers: tuple, factors: tuple[float, float]) -> Column:
    """Weights by the height of the base score: ``tiers`` are (least base, four weights), highest first."""
    out = None
    for least, weights in tiers[::-1]:
        value = base * weights[0] + title * weights[1] + confidence * factors[0] * weights[2] + relevance * factors[1] * weights[3]
        out = value if out is None else F.when(base >= least, value).otherwise(out)
    return out


FIRST_TIERS = ((50, (0.85, 0.10, 0.03, 0.02)), (20, (0.75, 0.15, 0.07, 0.03)), (None, (0.60, 0.30, 0.05, 0.05)))
SECOND_TIERS = ((50, (0.80, 0.15, 0.03, 0.02)), (20, (0.70, 0.20, 0.07, 0.03)), (None, (0.40, 0.40, 0.10, 0.10)))


def quality(content: Column) -> Column:
    """Capped counts of quality terms and image marks, and a bonus for numbered statements."""
    c = F.lower(content)
    numbered = any_of(content, ["①", "1.", "（1）"])
    score = F.least(matches(c, L.QUALITY_TERMS) * 0.1, F.lit(0.5)) + F.least(matches(c, L.IMAGE_MARKS) * 0.15, F.lit(0.3)) + F.when(numbered, 0.2).otherwise(0.0)
    return F.when(content == "", 0.0).otherwise(F.least(score, F.lit(1.0)))


def image_relevance(content: Column) -> Column:
    c = F.lower(content)
    score = matches(c, L.IMAGE_WORDS) * 0.2 + matches(c, L.FEATURE_WORDS) * 0.15 + F.least(matches(c, L.MORPHOLOGY) * 0.1, F.lit(0.4))
    return F.when(content == "", 0.0).otherwise(F.least(score, F.lit(1.0)))


def is_high_quality(content: Column) -> Column:
    return (F.length(content) >= 50) & (matches(content, L.QUALITY_INDICATORS) >= 2) & (matches(content, ["。", "；", "："]) >= 1)


def chapter_boost(score: Column, query: Column, content: Column, chapter: Column, section: Column) -> Column:
    """The score, raised for chapter structure, an entity of the query in a title and quality, and capped at 1."""
    numbers = r"第[一二三四五六七八九十]+[节章]|第[0-9]+[节章]"
    structure = content.rlike(numbers) | chapter.rlike(numbers) | section.rlike(numbers)
    entity = F.exists(contained(query, L.KEY_ENTITIES), lambda e: F.contains(chapter, e) | F.contains(section, e))
    bonus = F.when(structure, 0.2).otherwise(0.0) + F.when(entity, 0.3).otherwise(0.0) + F.when(is_high_quality(content), 0.1).otherwise(0.0)
    return F.least(score + bonus, F.lit(1.0))


def relevance(raw: Column, highest: Column) -> Column:
    """Scores up to 1 stay, higher ones are scaled by the highest, or by their size where that is unknown."""
    by_size = F.when(raw <= 10, raw / 10.0).when(raw <= 100, 0.9 + (raw - 10.0) / 900.0).otherwise(F.least(0.95 + F.log10(raw) / 100.0, F.lit(1.0)))
    return F.when(raw <= 1, raw).when(highest > 0, F.least(raw / highest, F.lit(1.0))).otherwise(by_size)


def level(relevance_score: Column) -> Column:
    return F.when(relevance_score >= 0.9, "very high").when(relevance_score >= 0.8, "high").when(relevance_score >= 0.6, "medium").when(relevance_score >= 0.4, "low").otherwise("very low")
