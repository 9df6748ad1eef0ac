"""Cut oversized texts at natural boundaries by dynamic programming.

For each text above the limit the candidate cuts are its line ends, sentence and clause ends, and, where
two natural cuts lie further apart than the limit, forced positions (at a comma or white space if there
is one). Dynamic programming over these positions chooses the cuts with the least total of cut
penalties and squared deviations from the balanced piece length, under the length limit. Each piece
begins ``overlap`` characters before the cut that ends its predecessor; the overlap is shortened only
where the piece could not reach the next natural cut otherwise.

Scale: texts within the limit are filtered out inside the scan projection, before any shuffle; the rest
shrinks to distinct records by a hash aggregation and every text is cut on its own. Candidates are only
compared within one limit's length, so the work is linear in the length of a text.

Edge cases: null and empty contents give no piece; contents within the limit give one piece of kind
``whole``; lengths are those after spaces, carriage returns and line feeds at both ends are removed;
repeated rows count once; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources.tables import table

MAX_CHARS = 800
OVERLAP = 80

#: A cut after a match costs this much; the last two are forced cuts.
PARAGRAPH, LINE, SENTENCE, CLAUSE, COMMA, ANYWHERE = 0.0, 0.5, 1.0, 2.0, 1000.0, 1100.0
_CUTS = (
    (re.compile(r"[；;][”’」』）)\]]*"), CLAUSE),
    (re.compile(r"[。！？!?।]+[”’」』）)\]\"]*|\.(?=\s)"), SENTENCE),
    (re.compile(r"\r?\n|\r"), LINE),
    (re.compile(r"\r?\n\s*\n"), PARAGRAPH),
)
_WEAK = re.compile(r"[，,、：:]|\s")


def candidate_cuts(text: str, max_chars: int, overlap: int) -> tuple[list[int], list[float]]:
    """Positions where the text may be cut, ends included, and the penalty of each."""
    n = len(text)
    cost: dict[int, float] = {}
    for pattern, penalty in _CUTS:
        for m in pattern.finditer(text):
            if m.end() < n:
                cost[m.end()] = penalty
    natural = [0, *sorted(cost), n]
    for a, b in zip(natural, natural[1:], strict=False):
        if b - a > max_chars:
            for m in _WEAK.finditer(text, a + 1, b):
                if a < m.end() < b:
                    cost.setdefault(m.end(), COMMA)
            for p in range(a + max_chars - overlap, b, max(1, (max_chars - overlap) // 2)):
                cost.setdefault(p, ANYWHERE)
    positions = [0, *sorted(cost), n]
    return positions, [0.0, *(cost[p] for p in positions[1:-1]), 0.0]


def split_text(text: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """``(start, end, cut_kind)`` of the pieces of one text; the kind tells how the piece's end was found."""
    n = len(text)
    if n == 0:
        return []
    if n <= max_chars:
        return [(0, n, "whole")]
    positions, penalty = candidate_cuts(text, max_chars, overlap)
    pieces = -(-(n - overlap) // (max_chars - overlap))
    target = (n - overlap) / pieces + overlap
    best, back = [0.0] + [float("inf")] * (len(positions) - 1), [0] * len(positions)
    for j in range(1, len(positions)):
        end = positions[j]
        for i in range(bisect_left(positions, end - max_chars), j):
            if best[i] == float("inf"):
                continue
            start = max(positions[i] - overlap, 0)
            short = max(0, end - start - max_chars)  # by so much the overlap would have to shrink
            size = end - start - short
            cost = best[i] + penalty[j] + 4.0 * ((size - target) / target) ** 2 + (20.0 * short / overlap if short else 0.0)
            if cost < best[j]:
                best[j], back[j] = cost, i
    out, j = [], len(positions) - 1
    while j > 0:
        i = back[j]
        start = max(positions[i] - overlap, 0, positions[j] - max_chars)
        out.append((start, positions[j], "forced" if penalty[j] >= COMMA else "end" if positions[j] == n else "natural"))
        j = i
    return out[::-1]


def _pieces(max_chars: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            take = []
            for r, text in enumerate(batch.column("body").to_pylist()):
                for k, (start, end, kind) in enumerate(split_text(text, max_chars, overlap)):
                    take.append(r)
                    for column, value in zip(rows, (k, start, end, text[start:end], kind, end - start), strict=True):
                        column.append(value)
            index = pa.array(take, pa.int64())
            keys = [batch.column(c).take(index) for c in ("doc_id", "chapter_title", "section_title")]
            yield pa.RecordBatch.from_arrays(
                [*keys, pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.string()), pa.array(rows[4], pa.string()), pa.array(rows[5], pa.int32())],
                ["doc_id", "chapter_title", "section_title", "piece_no", "start_char", "end_char", "piece", "cut_kind", "n_chars"],
            )

    return run


def split_oversized(records: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP, only_oversized: bool = False) -> DataFrame:
    """Pieces of the distinct records' contents, each with its document's chapter and section title."""
    if not 0 <= overlap < max_chars:
        raise ValueError("the overlap must be smaller than the limit")
    body = F.btrim(F.col("content"), F.lit(" \r\n"))
    rows = records.where(F.col("content").isNotNull()).select(F.col("doc_id").cast("string").alias("doc_id"), "chapter_title", "section_title", body.alias("body"))
    rows = rows.where(F.length("body") > (max_chars if only_oversized else 0)).distinct()
    schema = "doc_id string, chapter_title string, section_title string, piece_no int, start_char int, end_char int, piece string, cut_kind string, n_chars int"
    return rows.mapInArrow(_pieces(max_chars, overlap), schema)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """How each oversized content can be cut: ``forced`` if one of its cuts is."""
    pieces = split_oversized(table(spark, folder, "search_results"), only_oversized=True)
    return pieces.groupBy("doc_id").agg(F.when(F.max((F.col("cut_kind") == "forced").cast("int")) == 1, "forced").otherwise("natural").alias("cut_kind"))


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_oversized(table(spark, folder, "search_results"))


QUERIES = {"p3_found": p3_found, "p3_pieces": p3_pieces}
SQL = {
    "p3_found": r"""
        WITH t AS (SELECT DISTINCT doc_id, trim(content, ' ' || chr(13) || chr(10)) AS body FROM search_results WHERE content IS NOT NULL),
             s AS (SELECT doc_id, max(length(x)) AS longest
                   FROM (SELECT doc_id, unnest(string_split_regex(body, '[\n\r。！？；!?;।]|\.\s')) AS x FROM t WHERE length(body) > 800) GROUP BY doc_id)
        SELECT doc_id, CASE WHEN longest > 800 THEN 'forced' ELSE 'natural' END AS cut_kind FROM s""",
}
