"""Pages of repeated keywords, link lists or product tags instead of sentences.

Two measures are combined:

* coverage: the share of a page's characters (digits masked) inside substrings that occur at least
  ``TIMES`` times in it and have a minimum length. The page's suffix automaton gives, for each position,
  the longest such substring that ends there; all of them are maximal repeats or parts of one. Coverage is taken with two
  minimum lengths, that of words (``WORDS``) and that of phrases (``PHRASES``), for Han or kana text and others.
* missing clause structure: the share of characters in links and runs of tags (listed), and that in sentences or lines that hold
  less than one function word or predicate of their language in ``SPARSE`` characters (Han text, others; bare). Contents lists,
  bibliographies and tables have a structure of their own and do not count as missing.

``score = 1 - (1 - listed - bare * support) * (1 - excess)``: bare pieces count only as far as words repeat (support grows from 0
to 1 up to a coverage of words of ``SUPPORT``), and repeated phrases count by themselves where they cover more than formulaic
prose does (excess grows from 0 to 1 between a coverage of phrases of 0.78 and 0.92); pages above 0.5 are spam.

Scale: a page is judged from its own text in one pass over the table, without a shuffle. The characters covered by repeated
substrings of a minimum length are those covered by repeated substrings of just that length, since the longer ones consist
of such. That is counted for a whole batch of pages at once, and where it shows that a page cannot come above the wanted score no automaton is
built. A page longer than ``AUTOMATON_CHARS`` takes its coverage from that count, which has the same value and needs less memory.

Edge cases: null, empty and blank texts are no spam (they give no row); repeated rows count once; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources.tables import table

TIMES = 3
#: Minimum lengths of repeated substrings, in Han or kana text and in other text.
WORDS, PHRASES = (2, 5), (6, 12)
SUPPORT = 0.2
#: Longer pages get no automaton, but the same coverage by counting.
AUTOMATON_CHARS = 200_000
SPARSE = (60, 160)

LINK = r"<a\s[^<>]*>[^<]*</a>|\[[^\[\]\n]*\]\(https?://[^()\s]*\)|https?://[^\s<>\"'|]+"
#: Three tags or more in a row.
TAGS = r"(?:#[^\s#]+\s*){3,}"
# Function words and predicates that clauses of these languages do not lack.
_HAN_WORDS = "的是为有和与及或但而则其这该呈着了被把将可能会应宜须于中时后若如未不无较见指且因占仍便已曾之者伴示含由从至等"
_LATIN_WORDS = "the of and is are was were in with to for that by on as at be this from which or not when has have der die das und ist sind im mit zu für den dem eine ein bei nach nicht auf als von oder am sich neben zwischen wie so nur auch le la les et est dans avec pour du des une un au par sur que qui ou pas en"
_KANA = "はがをにでのともた"
_HAN_PREDICATES = "多表现"
_OTHER_WORDS = "(?:^|\\s)(?:में|है|हैं|और|के|की|का|से|को|या|एक|पर|यह|तथा|न|नहीं|मिली|गया|गईं)(?:\\s|$)|ที่|และ|ใน|มี|จาก|กับ|ของ|เพื่อ|ว่า|เมื่อ|พบ|ให้|ควร"


def counted_shares(texts: list[str], lengths: list[int], times: int = TIMES) -> np.ndarray:
    """For each text the share of its characters inside substrings of its given length that occur ``times`` times or more.

    Substrings are compared by a 64-bit hash; two different ones of a text coincide with a probability of 2 ** -64 a pair.
    """
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    wanted = np.asarray(lengths, np.int64)
    edges = np.zeros(len(codes) + 1, np.int64)
    for length in np.unique(wanted).tolist():
        n = len(codes) - length + 1
        if n <= 0:
            continue
        h = np.zeros(n, np.uint64)
        for k in range(length):
            h = (h ^ codes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        at = np.nonzero((owner[:n] == owner[length - 1 :]) & (wanted[owner[:n]] == length))[0]
        key = h[at] + owner[at].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        at = at[count[inverse] >= times]
        edges += np.bincount(at, minlength=len(edges)) - np.bincount(at + length, minlength=len(edges))
    covered = (np.cumsum(edges[:-1]) > 0).astype(np.int64)
    return np.bincount(owner, weights=covered, minlength=len(texts)) / np.maximum(1, sizes)


def repeated_shares(text: str, lengths: tuple[int, ...], times: int = TIMES) -> list[float]:
    """For each minimum length the share of characters inside maximal repeated substrings of at least that length, by the suffix automaton."""
    n = len(text)
    if n < min(lengths):
        return [0.0] * len(lengths)
    follow: list[dict[str, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    ends = []
    for c in text:
        cur = len(length)
        length.append(length[last] + 1)
        follow.append({})
        link.append(0)
        p = last
        while p != -1 and c not in follow[p]:
            follow[p][c] = cur
            p = link[p]
        if p != -1:
            q = follow[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(length)
                length.append(length[p] + 1)
                follow.append(follow[q].copy())
                link.append(link[q])
                while p != -1 and follow[p].get(c) == q:
                    follow[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
        ends.append(cur)
    size = np.array(length)
    parent = np.array(link)
    occurrences = np.zeros(len(size), np.int64)
    occurrences[ends] = 1
    order = np.argsort(-size, kind="stable").tolist()
    count = occurrences.tolist()
    for v in order:
        if link[v] > 0:
            count[link[v]] += count[v]
    reach = [0] * len(length)
    for v in reversed(order):
        if v:
            reach[v] = length[v] if count[v] >= times else reach[parent[v]]
    best = np.array([reach[v] for v in ends])
    shares = []
    for least in lengths:
        at = np.nonzero(best >= least)[0]
        edges = np.bincount(at - best[at] + 1, minlength=n + 1) - np.bincount(at + 1, minlength=n + 1)
        shares.append(float(np.count_nonzero(np.cumsum(edges[:n]) > 0)) / n)
    return shares


def score_of(listed: np.ndarray, bare: np.ndarray, words: np.ndarray, phrases: np.ndarray) -> np.ndarray:
    support = np.minimum(1.0, words / SUPPORT)
    excess = np.clip((phrases - 0.78) / 0.14, 0.0, 1.0)
    return 1 - (1 - np.minimum(1.0, listed + bare * support)) * (1 - excess)


def _coverage(above: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts, kind = part.column("masked").to_pylist(), part.column("kind").to_numpy()
                listed, bare = part.column("listed").to_numpy(), part.column("bare").to_numpy()
                words = counted_shares(texts, [WORDS[k] for k in kind])
                phrases = counted_shares(texts, [PHRASES[k] for k in kind])
                # the counts are exact, so pages that do not reach the score with them are settled
                open_pages = np.arange(len(texts)) if above is None else np.nonzero(score_of(listed, bare, words, phrases) > above - 1e-9)[0]
                for i in open_pages.tolist():
                    if len(texts[i]) <= AUTOMATON_CHARS:
                        words[i], phrases[i] = repeated_shares(texts[i], (WORDS[kind[i]], PHRASES[kind[i]]))
                keep = pa.array(open_pages)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(keep) for c in ("doc_id", "listed", "bare")), pa.array(words[open_pages]), pa.array(phrases[open_pages]), pa.array(score_of(listed, bare, words, phrases)[open_pages])],
                    ["doc_id", "listed", "bare", "word_coverage", "phrase_coverage", "score"],
                )

    return run


def _size(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"(?U)\s+", ""))


def missing_structure(pages: DataFrame) -> DataFrame:
    """Adds ``listed`` and ``bare``: shares of ``text`` in links and tags, and in pieces without clause structure; null for blank texts.

    The steps are columns of their own, so that each is computed once a page.
    """
    text = F.col("text")
    steps = pages.withColumn("total", _size(text)).withColumn("links", F.aggregate(F.regexp_extract_all(text, F.lit(f"({LINK})"), F.lit(1)), F.lit(0), lambda acc, x: acc + F.length(x)))
    steps = steps.withColumn("rest", F.regexp_replace(F.when(F.col("links") > 0, F.regexp_replace(text, LINK, " \n")).otherwise(text), r"<[^<>\n]*>", "\n"))
    steps = steps.withColumn("tags", F.aggregate(F.regexp_extract_all("rest", F.lit(f"({TAGS})"), F.lit(1)), F.lit(0), lambda acc, x: acc + _size(x)))
    lines = F.filter(F.split(F.when(F.col("tags") > 0, F.regexp_replace("rest", TAGS, "\n")).otherwise(F.col("rest")), r"\r?\n"), lambda l: F.trim(l) != "")
    steps = steps.withColumn("lines", lines)
    is_row = lambda l: l.rlike(r"^[^|]*(\|[^|]*){2,8}$")
    steps = steps.withColumn("piped", F.filter("lines", is_row))
    is_table = (F.size("piped") >= 3) & (F.size(F.filter("piped", lambda l: l.rlike(r"(^|\|)\s*[0-9][0-9.]*\s*%?\s*(\||$)"))) * 10 >= F.size("piped") * 6)

    def structured(line: Column) -> Column:
        contents = line.rlike(r"(\.{3,}|…{2,}|·{3,}|_{3,})\s*[0-9ivxlIVXL]+\s*$")
        source = line.rlike(r"^\s*(\[[0-9]+\]|[0-9]+\.)\s.*\b(19|20)[0-9]{2}\b")
        return contents | source

    prose = F.when(is_table, F.filter("lines", lambda l: ~is_row(l))).otherwise(F.col("lines"))
    pieces = F.flatten(F.transform(F.filter(prose, lambda l: ~structured(l)), lambda l: F.split(l, r"[。！？!?]+|\.(?=\s|$)")))
    latin = _LATIN_WORDS.split()
    measured = F.transform(pieces, lambda p: F.struct(F.lower(p).alias("low"), _size(p).alias("size")))

    def count(p: Column) -> Column:
        foreign = F.when(p.rlike("[ऀ-ॿ฀-๿]"), F.regexp_count(p, F.lit(_OTHER_WORDS))).otherwise(0)
        words = F.when(p.rlike("[a-z]"), F.size(F.filter(F.regexp_extract_all(p, F.lit(r"\p{L}+"), F.lit(0)), lambda w: w.isin(latin)))).otherwise(0)
        return F.regexp_count(p, F.lit(f"[{_HAN_WORDS}{_KANA}]")) + F.regexp_count(p, F.lit(_HAN_PREDICATES)) + foreign + words

    reach = lambda p: F.when(p.rlike("[一-鿿]"), SPARSE[0]).otherwise(SPARSE[1])
    bare = F.aggregate(measured, F.lit(0), lambda acc, p: acc + F.when((p["size"] == 0) | (count(p["low"]) * reach(p["low"]) >= p["size"]), 0).otherwise(p["size"]))
    share = lambda n: F.when(F.col("total") > 0, F.least(F.lit(1.0), n / F.col("total")))
    return steps.withColumn("listed", share(F.col("links") + F.col("tags"))).withColumn("bare", share(bare))


def spam_scores(pages: DataFrame, above: float | None = None) -> DataFrame:
    """``(doc_id, listed, bare, word_coverage, phrase_coverage, score)`` of the pages, of all or of those with a score above ``above``."""
    text = F.col("text")
    cjk = F.regexp_count(text, F.lit("[぀-ヿ㐀-䶿一-鿿]"))
    masked = F.regexp_replace(F.regexp_replace(text, "[0-9]+", "9"), r"(?U)\s+", " ")
    rows = missing_structure(pages.where(text.rlike(r"(?U)\S")).select("doc_id", "text")).select("doc_id", "listed", "bare", masked.alias("masked"), F.when(cjk * 10 >= F.length(text) * 3, 0).otherwise(1).alias("kind"))
    judged = rows.mapInArrow(_coverage(above), "doc_id long, listed double, bare double, word_coverage double, phrase_coverage double, score double")
    return judged if above is None else judged.where(F.col("score") > above)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return spam_scores(table(spark, folder, "documents"), above=0.5).select("doc_id").distinct()


QUERIES = {"p8_found": p8_found}
