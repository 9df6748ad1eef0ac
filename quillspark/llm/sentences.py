"""Sentence units of texts in many languages and scripts.

Blank lines, headings, list lines and long runs without an end mark bound blocks; inside a block the end
marks form a lattice of possible gaps that is walked once, with the open quotations and brackets on a
stack. What is quoted or bracketed stays with its sentence.

* Spaced scripts: a full stop ends a unit unless it stands in a number, an abbreviation (a fixed list,
  and tokens that the corpus continues in lower case or with a digit), an initial or an ordinal.
* Spaceless scripts: an unambiguous mark ends a unit. After a quotation that is neither announced by a
  colon nor reported afterwards, and after an ellipsis, the mark alone does not tell. There the text right of
  the gap is segmented with a word lattice over a dictionary of the corpus and the gap is classified by
  its first word (how often it opens sentences, how often clauses) and by the last word left of it (how
  often it closes sentences).
* Thai: a space between two Thai words ends a unit.

The dictionary is counted with Spark over all texts: up to four characters after and two before sentence
ends and clause commas, and tokens before full stops; entries seen less than ``MIN_COUNT`` times count as unknown words. It stays a
distributed table. A first walk lists what each text would ask of it: the gaps that their marks leave open, each with the ``LEFT`` and
``RIGHT`` characters beside it, and the tokens before full stops. The distinct gaps meet the dictionary's words in an equi-join, are
classified, and go back to their texts for the walk that cuts them. A report of a quotation is looked for in the ``REPORT`` characters
behind it, a token before a full stop in the ``TOKEN`` characters before it.

Edge cases: null contents give no unit, nor do empty ones and those of white space; a quotation or bracket that is
never closed in its block is taken as an ordinary character; repeated rows count once; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.session import cut_lineage
from quillspark.sources.tables import table

MIN_COUNT = 5
#: What a gap is classified by, how far behind a quotation its report begins, and how long a token before a full stop is.
LEFT, RIGHT, REPORT, TOKEN = 2, 8, 60, 24
#: Lines of at least this length without any end mark are a unit of their own.
LONG_RUN = 150

# Abbreviations after which a full stop ends no sentence, and those that need a number after them.
ABBREVIATIONS = frozenset("mr mrs ms dr prof st vs cf approx al ca env ex e.g i.e bzw vgl evtl ggf inkl bspw mme resp incl esp डॉ श्री प्रो".split())
BEFORE_NUMBER = frozenset("no nos nr fig figs abb tab table ver vol p pp eq sec ch art bd s".split())
#: Words before a number with a full stop that make it an ordinal.
BEFORE_ORDINAL = frozenset("am der den dem des das die vom zum zur im bis ab seit nach".split())
#: Words that report a quotation before them.
REPORTED = re.compile("写道|记录|说道|表示|指出|记了|^と|^って|との|記した|述べ|言った")

_TERMINATORS = "。！？!?।॥.…"
_PAIRS = {"“": "”", "„": "“", "「": "」", "『": "』", "«": "»", "(": ")", "（": "）", "[": "]", "【": "】", "《": "》", '"': '"'}
_CLOSERS = frozenset(_PAIRS.values()) - {"“", '"'}
_QUOTES = frozenset('“„「『«"')
_MARK = re.compile(r'[。！？!?।॥.…]+|["“”„「」『』«»()（）\[\]【】《》]')
_HEADING = re.compile(r"\s*#{1,6}\s")
_BULLET = re.compile(r"\s*[-*•‣▪◦–]\s+\S")
#: A number opens a list line only where no sentence is going on: a wrapped line may begin with one, too.
_NUMBERED = re.compile(r"\s*(?:[0-9]{1,3}[.、]\s+|[0-9]{1,3}\)\s*|[(（][0-9]{1,3}[)）]\s*)\S")
#: Names such as pH or p40 begin a sentence in lower case, and so does a foreign word in Chinese text.
_NAME = re.compile(r"[a-zα-ω]{1,2}[A-Z0-9]|[a-z]+(?=[一-鿿])")
_ENDS = re.compile(r"[。！？!?।॥]|\.(?:\s|$)|\.(?=[一-鿿])")
_THAI = re.compile(r"[ก-ะา-ๅ็-๎]")
_THAI_GAP = re.compile(r"(?<=[ก-ๅ็-๎])\s+(?=[ก-ๅ็-๎])")
_TOKEN = re.compile(r"[^\W_]+(?:[.'’][^\W_]+)*[ऀ-ॣॱ-ॿ]*$")
_SPACELESS = re.compile(r"[぀-ヿ㐀-䶿一-鿿]")


class Lexicon:
    """Counts of the words around sentence gaps, and abbreviations learned from the corpus."""

    def __init__(self, openers: dict[str, tuple[int, int]], finals: dict[str, tuple[int, int]], abbreviations: frozenset[str]):
        self.openers, self.finals, self.abbreviations = openers, finals, abbreviations
        self.total = sum(a + b for a, b in openers.values()) or 1

    def first_word(self, text: str) -> str:
        """The first word of the likeliest path through the dictionary's words in ``text``."""
        n = len(text)
        best: list[tuple[float, int]] = [(0.0, n)] * (n + 1)
        for i in range(n - 1, -1, -1):
            best[i] = (best[i + 1][0] - 14.0, i + 1)
            for k in range(1, min(4, n - i) + 1):
                seen = self.openers.get(text[i : i + k])
                if seen:
                    score = best[i + k][0] + log((seen[0] + seen[1]) / self.total)
                    if score > best[i][0]:
                        best[i] = (score, i + k)
        return text[: best[0][1]] if n else ""

    def is_gap(self, left: str, right: str) -> bool:
        """Whether a sentence ends between ``left`` and ``right``."""
        word = self.first_word(right[:RIGHT])
        opens, inner = self.openers.get(word, (0, 0))
        score = log((opens + 0.5) / (inner + 0.5))
        closes, pauses = next((self.finals[w] for w in (left[-2:], left[-1:]) if w in self.finals), (0, 0))
        return score + 0.5 * log((closes + 1) / (pauses + 1)) > 0 and opens > 0


class Asked:
    """Notes what a text asks of the dictionary; every gap gets the same ``answer``."""

    def __init__(self, answer: bool):
        self.answer, self.gaps, self.stops = answer, set(), set()
        self.abbreviations = self

    def is_gap(self, left: str, right: str) -> bool:
        self.gaps.add((left, right))
        return self.answer

    def __contains__(self, token: str) -> bool:
        self.stops.add(token)
        return False


class Decided:
    """The dictionary's answers for one text."""

    def __init__(self, answers: list[str]):
        self.gaps = {x[1:] for x in answers if x[0] == "g"}
        self.abbreviations = {x[1:] for x in answers if x[0] == "s"}

    def is_gap(self, left: str, right: str) -> bool:
        return left + "\x00" + right in self.gaps


def blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """``(start, end, whole)`` of the blocks; a whole block is one unit."""
    pos, start, last = 0, None, ""
    for line in text.split("\n"):
        end = pos + len(line)
        s = line.strip()
        whole = False
        if s:
            whole = bool(_HEADING.match(line) or _BULLET.match(line))
            if not whole and _NUMBERED.match(line) and (start is None or (last.rstrip("”’」』\"）)»“")[-1:] or "x") in _TERMINATORS):
                whole = True
            if not whole and len(s) >= LONG_RUN and not _ENDS.search(s) and not _THAI.search(s):
                whole = True
        if not s or whole:
            if start is not None:
                yield start, pos, False
                start = None
            if whole:
                yield pos, end, True
        elif start is None:
            start = pos
        last = s
        pos = end + 1
    if start is not None:
        yield start, len(text), False


def _full_stop_ends(text: str, i: int, j: int, end: int, begin: int, lexicon: Lexicon) -> bool:
    """Whether the run of full stops ``text[i:j]`` outside quotations ends a unit."""
    before = text[i - 1] if i > begin else ""
    after = text[j] if j < end else ""
    k = j
    while k < end and (text[k].isspace() or text[k] in _CLOSERS):
        k += 1
    nxt = text[k] if k < end else ""
    if not nxt:
        return True
    if j - i > 1:
        return nxt.isupper() or bool(_SPACELESS.match(nxt) and lexicon.is_gap(text[max(begin, i - LEFT) : i], text[k : k + RIGHT]))
    if _SPACELESS.match(before):
        return nxt not in "，,、；;：:"
    if before in "”」』）)%％":
        return not ((nxt.islower() and not _NAME.match(text, k)) or nxt in "，,、；;：:")
    token = _TOKEN.search(text, max(begin, i - TOKEN), i)
    word = token.group() if token else ""
    if before.isdigit() and after.isdigit():
        return False
    if not (after.isspace() or after in _CLOSERS or after in _QUOTES):
        # no space after the stop: only between a plain word or name and a capitalised word, or before a Han character
        if _SPACELESS.match(after):
            return word.lower() not in ABBREVIATIONS and len(word) > 1
        capital = after.isupper() and j + 1 < end and (text[j + 1].islower() or text[j + 1].isspace())
        return capital and word.isalnum() and len(word) > 1 and word.lower() not in ABBREVIATIONS
    if (nxt.islower() and not _NAME.match(text, k)) or nxt in ",;:，；：":
        return False
    low = word.lower()
    if low in ABBREVIATIONS or (low in BEFORE_NUMBER and nxt.isdigit()) or (low in lexicon.abbreviations and not nxt.isupper()):
        return False
    if len(word) == 1 and word.isalpha():
        return False
    if word.isdigit() and len(word) <= 2:
        previous = re.search(r"([^\W\d_]+)\s+$", text[max(begin, i - TOKEN) : i - len(word)])
        if previous and previous.group(1).lower() in BEFORE_ORDINAL:
            return False
    return True


def _walk(text: str, begin: int, end: int, lexicon: Lexicon) -> Iterator[int]:
    """Positions after which a unit of the block ``text[begin:end]`` ends."""
    stack: list[tuple[str, int, bool]] = []
    unit = begin
    while unit < end and text[unit].isspace():
        unit += 1
    skip = begin
    for m in _MARK.finditer(text, begin, end):
        i, j, mark = m.start(), m.end(), text[m.start()]
        if i < skip:
            continue
        cut = -1
        if mark in _TERMINATORS:
            if stack:
                continue
            run = m.group()
            if not run.strip("."):
                ends = _full_stop_ends(text, i, j, end, begin, lexicon)
            elif not run.strip("….") :
                k = j
                while k < end and text[k].isspace():
                    k += 1
                ends = k >= end or text[k].isupper() or bool(_SPACELESS.match(text[k]) and lexicon.is_gap(text[max(begin, i - LEFT) : i], text[k : k + RIGHT]))
            elif run[-1] in "!?":
                k = j
                while k < end and text[k].isspace():
                    k += 1
                ends = k >= end or not ((text[k].islower() and not _NAME.match(text, k)) or text[k] in ",;，；、")
            else:
                ends = True
            if ends:
                cut = j
                while cut < end and text[cut] in _CLOSERS:
                    cut += 1
        elif stack and mark == _PAIRS[stack[-1][0]]:
            opener, at, announced = stack.pop()
            if stack:
                continue
            k = i - 1
            while k > at and text[k].isspace():
                k -= 1
            if text[k] not in _TERMINATORS:
                continue
            k = j
            while k < end and text[k].isspace():
                k += 1
            nxt = text[k] if k < end else ""
            if nxt and (nxt in _TERMINATORS or nxt in "，,、；;：:" or nxt in _CLOSERS):
                continue
            if opener not in _QUOTES:
                ends = at == unit
            elif not nxt or announced:
                ends = True
            elif not _SPACELESS.match(nxt):
                ends = not nxt.islower() or bool(_NAME.match(text, k))
            elif at == unit:
                clause = re.split("[。！？!?]", text[k : k + REPORT], maxsplit=1)[0]
                ends = not REPORTED.search(clause)
            else:
                ends = lexicon.is_gap(text[max(begin, at - LEFT) : at], text[k : k + RIGHT])
            if ends:
                cut = j
        elif mark in _PAIRS:
            if text.find(_PAIRS[mark], j, end) >= 0:
                k = i - 1
                while k >= begin and text[k].isspace():
                    k -= 1
                stack.append((mark, i, k >= unit and text[k] in ":："))
        elif len(stack) > 1 and any(mark == _PAIRS[s[0]] for s in stack):
            while mark != _PAIRS[stack.pop()[0]]:
                pass
        if cut >= 0:
            yield cut
            unit = cut
            while unit < end and text[unit].isspace():
                unit += 1
            skip = cut


def units(text: str, lexicon: Lexicon) -> list[tuple[int, int]]:
    """``(start, end)`` of the sentence units of a text."""
    out = []

    def add(a: int, b: int) -> None:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b))

    for begin, end, whole in blocks(text):
        if whole:
            add(begin, end)
            continue
        cuts = list(_walk(text, begin, end, lexicon))
        if _THAI.search(text, begin, end):
            cuts = sorted({*cuts, *(m.start() for m in _THAI_GAP.finditer(text, begin, end))})
        at = begin
        for cut in cuts:
            add(at, cut)
            at = cut
        add(at, end)
    return out


_HAN = r"぀-ヿ㐀-䶿一-鿿"


def gap_counts(texts: DataFrame) -> DataFrame:
    """``(side, word, at_end, inside)``: how often words stand beside sentence ends and beside clause commas."""
    c = F.col("content")

    def found(side: str, ending: bool, pattern: str) -> F.Column:
        hits = F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
        return F.transform(hits, lambda w: F.struct(F.lit(side).alias("side"), F.lit(ending).alias("ending"), w.alias("word")))

    spots = F.concat(
        found("open", True, rf"[。！？](?![”」』）])\s*([{_HAN}]{{1,4}})"),
        found("open", False, rf"[，、](?:\s*)([{_HAN}]{{1,4}})"),
        found("final", True, rf"([{_HAN}]{{1,2}})[。！？]"),
        found("final", False, rf"([{_HAN}]{{1,2}})[，、]"),
        found("stop", False, r"(?:^|[\s(（])(\p{L}{1,8})\.\s(?=\p{Ll}|[0-9])"),
        found("stop", True, r"(?:^|[\s(（])(\p{L}{1,8})\.\s+(?=\p{Lu})"),
    )
    counted = texts.select(F.explode(spots).alias("x")).select("x.side", "x.ending", "x.word").groupBy("side", "ending", "word").agg(F.count("*").alias("n"))
    # shorter words at the same place
    lengths = F.when(F.col("side") == "open", F.sequence(F.lit(1), F.length("word"))).when(F.col("side") == "final", F.sequence(F.lit(1), F.length("word"))).otherwise(F.array(F.length("word")))
    cut = F.when(F.col("side") == "final", F.expr("right(word, k)")).otherwise(F.expr("left(word, k)"))
    return counted.withColumn("k", F.explode(lengths)).select("side", "ending", cut.alias("word"), "n").groupBy("side", "word").agg(F.sum(F.when(F.col("ending"), F.col("n")).otherwise(0)).alias("at_end"), F.sum(F.when(F.col("ending"), 0).otherwise(F.col("n"))).alias("inside"))


def learned_abbreviations(counts: DataFrame) -> DataFrame:
    """``key``: tokens whose full stop is mostly followed by a small letter or a digit."""
    return counts.where("side = 'stop' AND at_end + inside >= %d AND inside >= 20 * (at_end + 1)" % MIN_COUNT).select(F.lower("word").alias("key")).distinct()


def _questions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(text_id, kind, key)``: gaps (``g``) and tokens (``s``) that a text asks for, whatever the answers are."""
    for batch in batches:
        ids, kinds, keys = [], [], []
        for r, text in enumerate(batch.column(1).to_pylist()):
            gaps, stops = set(), set()
            for answer in (False, True):
                notes = Asked(answer)
                units(text, notes)
                gaps |= notes.gaps
                stops |= notes.stops
            for kind, found in (("g", [a + "\x00" + b for a, b in gaps]), ("s", stops)):
                ids += [r] * len(found)
                kinds += [kind] * len(found)
                keys += found
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(kinds, pa.string()), pa.array(keys, pa.string())], ["text_id", "kind", "key"])


def decided_gaps(gaps: DataFrame, counts: DataFrame) -> DataFrame:
    """The ``key`` of the distinct gaps (text left, a zero, text right) that end a sentence.

    Every word that the lattice could use, at most four characters at each of ``RIGHT`` places, is looked up by an equi-join.
    """
    left, right = F.split_part("key", F.lit("\x00"), F.lit(1)), F.split_part("key", F.lit("\x00"), F.lit(2))
    starts = F.sequence(F.lit(1), F.length(right))
    openers = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(4), F.length(right) - i + 1)), lambda n: F.struct(F.lit("open").alias("side"), F.substring(right, i, n).alias("word")))))
    finals = F.array(*[F.struct(F.lit("final").alias("side"), F.substring(left, -n, F.lit(n)).alias("word")) for n in (1, 2)])
    wanted = gaps.select("key", F.explode(F.array_distinct(F.concat(F.when(F.length(right) > 0, openers).otherwise(F.array().cast("array<struct<side:string,word:string>>")), finals))).alias("x")).select("key", "x.side", "x.word")
    known = counts.where(F.col("at_end") + F.col("inside") >= MIN_COUNT)
    total = known.where("side = 'open'").agg(F.coalesce(F.sum(F.col("at_end") + F.col("inside")), F.lit(0)).alias("n")).first()["n"]
    entries = wanted.join(known, ["side", "word"]).groupBy("key").agg(F.collect_list(F.struct("side", "word", "at_end", "inside")).alias("entries"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for r, (key, found) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                pick = {side: {e["word"]: (e["at_end"], e["inside"]) for e in found if e["side"] == side} for side in ("open", "final")}
                lexicon = Lexicon(pick["open"], pick["final"], frozenset())
                lexicon.total = total or 1
                if lexicon.is_gap(*key.split("\x00")):
                    keep.append(r)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64()))], ["key"])

    # gaps without any known word right of them are none
    return entries.mapInArrow(run, "key string")


def sentence_units(records: DataFrame) -> DataFrame:
    """``(doc_id, start_char, end_char)`` of the units of the distinct records' contents."""
    rows = records.where(F.col("content").isNotNull()).select(F.col("doc_id").cast("string").alias("doc_id"), "content").distinct()
    counts = cut_lineage(gap_counts(rows))
    asked = cut_lineage(rows.select(F.xxhash64("content").alias("text_id"), "content").mapInArrow(_questions, "text_id long, kind string, key string").distinct())
    gaps = decided_gaps(asked.where("kind = 'g'").select("key").distinct(), counts)
    yes = gaps.select(F.lit("g").alias("kind"), "key").unionByName(learned_abbreviations(counts).select(F.lit("s").alias("kind"), "key"))
    answers = asked.join(yes, ["kind", "key"], "left_semi").groupBy("text_id").agg(F.collect_list(F.concat("kind", "key")).alias("answers"))
    texts = rows.withColumn("text_id", F.xxhash64("content")).join(answers, "text_id", "left").select("doc_id", "content", "answers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, starts, ends = [], [], []
            for r, (text, known) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for a, b in units(text, Decided(known or [])):
                    take.append(r)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["doc_id", "start_char", "end_char"])

    return texts.mapInArrow(run, "doc_id string, start_char int, end_char int")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentence_units(table(spark, folder, "search_results").where("collection IS NULL OR collection != 'atlas_scan'"))


QUERIES = {"p4_found": p4_found}
