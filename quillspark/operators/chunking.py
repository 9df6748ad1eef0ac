"""From marked-up text to sections and chunks."""

from __future__ import annotations

from collections.abc import Iterator

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_CHAPTER = r"^#\s+(第[一二三四五六七八九十百]+章|Chapter\s+[0-9]+)"
_SECTION = r"^##\s+(第[一二三四五六七八九十百]+节|Section\s+[0-9]+)"


def lines_of(texts: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``(id, line_no, line)``, numbered from 1."""
    return texts.where(F.col(text_column).isNotNull()).select(F.col(id_column).alias("id"), F.posexplode(F.split(F.col(text_column), "\n")).alias("pos", "line")).select("id", (F.col("pos") + 1).alias("line_no"), F.regexp_replace("line", "\\r$", "").alias("line"))


def heading_kind(line: Column) -> Column:
    return F.when(line.rlike(_CHAPTER), "chapter").when(line.rlike(_SECTION), "section").when(line.rlike(r"^##\s+"), "other").otherwise("body")


def sections(texts: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``(id, section_no, chapter, section, page_no, body)``: runs of body lines under one heading.

    A chapter resets the section; pages count chapters and numbered sections. Blank lines are dropped.
    """
    rows = lines_of(texts, id_column, text_column).withColumn("kind", heading_kind(F.col("line")))
    w = Window.partitionBy("id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    title = F.trim(F.regexp_replace("line", "#", ""))
    rows = rows.withColumn("section_no", F.sum((F.col("kind") != "body").cast("int")).over(w))
    rows = rows.withColumn("chapter", F.coalesce(F.last(F.when(F.col("kind") == "chapter", title), True).over(w), F.lit("")))
    rows = rows.withColumn("section", F.coalesce(F.last(F.when(F.col("kind") == "chapter", F.lit("")).when(F.col("kind") != "body", title), True).over(w), F.lit("")))
    rows = rows.withColumn("page_no", 1 + F.sum(F.col("kind").isin("chapter", "section").cast("int")).over(w))
    body = rows.where("kind = 'body' AND trim(line) != ''")
    grouped = body.groupBy("id", "section_no", "chapter", "section", "page_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("lines"))
    return grouped.select("id", "section_no", "chapter", "section", "page_no", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("body"))


def fixed_chunks(texts: DataFrame, id_column: str, text_column: str, size: int) -> DataFrame:
    """``(id, chunk_no, chunk)`` of at most ``size`` characters."""
    n = F.length(text_column)
    rows = texts.where(F.col(text_column).isNotNull() & (n > 0))
    parts = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda k: F.substring(F.col(text_column), k * size + 1, F.lit(size)))
    return rows.select(F.col(id_column).alias("id"), F.posexplode(parts).alias("pos", "chunk")).select("id", (F.col("pos") + 1).alias("chunk_no"), "chunk")


_PARAGRAPH, _CHINESE, _LATIN = re.compile(r"\n\s*\n"), re.compile("[。！？；]"), re.compile(r"[.!?;]")


def boundary_split(text: str, target: int = 500, around: int = 100, near_paragraph: int = 50, near_mark: int = 80, least: int = 20, whole: int = 800) -> list[str]:
    """Pieces of about ``target`` characters that end at the mark nearest to it, measured from where a mark begins.

    A paragraph break within ``near_paragraph`` is preferred (and rules out other marks, near or not), then a
    Chinese mark within ``near_mark``, then, without any Chinese mark in reach, a Latin one.
    """
    text = text.strip()
    if len(text) <= whole:
        return [text] if text else []
    out, pos = [], 0
    while pos < len(text):
        end = min(pos + target, len(text))
        cut = end
        if end < len(text):
            lo, hi = max(end - around, pos), min(end + around, len(text))
            window, goal = text[lo:hi], end - lo
            breaks = [m.start() for m in _PARAGRAPH.finditer(window)]
            marks = [m.start() for m in _CHINESE.finditer(window)]
            # a paragraph break is cut off, a mark stays with its sentence
            if breaks:
                spots, reach, kept = breaks, near_paragraph, 0
            elif marks:
                spots, reach, kept = marks, near_mark, 1
            else:
                spots, reach, kept = [m.start() for m in _LATIN.finditer(window)], near_mark, 1
            best = min(spots, key=lambda s: abs(s - goal), default=None)
            if best is not None and abs(best - goal) <= reach and lo + best + kept > pos:
                cut = lo + best + kept
        piece = text[pos:cut].strip()
        if piece and (len(piece) >= least or cut >= len(text)):
            out.append(piece)
        elif piece and out:
            out[-1] += "\n" + piece
        elif piece:
            out.append(piece)
        pos = max(cut, pos + 1)
    return out


def boundary_chunks(texts: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``(id, chunk_no, chunk)`` by ``boundary_split``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, k + 1, c) for i, t in zip(batch["id"], batch["text"], strict=True) for k, c in enumerate(boundary_split(t))]
            yield pd.DataFrame(rows, columns=["id", "chunk_no", "chunk"])

    kind = dict(texts.dtypes)[id_column]
    return texts.where(F.col(text_column).isNotNull()).select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInPandas(run, f"id {kind}, chunk_no int, chunk string")


def clean_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def without_page_number(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(title, r"[.．。·\s]*[0-9]+\s*$", ""), r"[.．。·\s]+$", ""))


def figure_number(text: Column) -> Column:
    """The first figure number, Chinese or Latin; null if there is none."""
    out = None
    for pattern in (r"图\s*([0-9]+-[0-9]+[a-z]?)", r"Fig\.\s*([0-9]+[-.][0-9]+[a-z]?)", r"图\s*([0-9]+[a-z]?)"):
        value = F.regexp_extract(text, pattern, 1)
        value = F.when(value != "", value)
        out = value if out is None else F.coalesce(out, value)
    return out
