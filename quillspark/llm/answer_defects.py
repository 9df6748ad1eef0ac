"""Defective question-answer pairs and the kind of their defect.

Each pair gets at most one kind, the first that holds: ``empty``, ``copy``, ``refusal``,
``other_language``, ``truncated``. The first four are column expressions over one pair. An answer is truncated if

* it ends in an open bracket or quotation, in a clause mark, an enumerator or an ellipsis;
* sorted among all answers, its successor continues it (a shortened version of another answer), or sorted among the clauses of
  all answers, the successor of its last clause continues that one, which itself never ends a sentence;
* it has no end mark and its length is a spike in the lengths of such answers (a length limit);
* it has no end mark and the corpus never ends a sentence so: all answers are cut into clauses, and
  for the last two to four characters (one and two words in spaced scripts) of a clause, for its first
  characters, and for the sentence's first characters with the number of clauses so far, Spark counts how
  often a sentence goes on and how often it ends there.

An answer that is a mere term (one clause without any function word) needs no sentence and is not truncated by such statistics.

Scale: pairs are rows; clause statistics are aggregated on the map side and meet the few open answers in
an equi-join; sorted neighbours come from a range-partitioned sort of the distinct answers and clauses, of which only each
partition's first and last row are compared across partitions, empty partitions left out.

Edge cases: a null or blank answer is ``empty``, whatever its question is; a null question is an empty
one; repeated rows count once; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.session import cut_lineage
from quillspark.sources.tables import table

# What stands for an answer that was never given.
PLACEHOLDERS = "null none nil na n/a nan tbd todo tba unknown pending placeholder 待补充 暂无答案 暂无 无 无答案 待定 略 空 待填 未填写 答案 答 answer a".split()
#: Words that only introduce an answer or repeat that a question was asked.
FRAMES = "您问的是 你问的是 您的问题是 问题是 关于 这一问题 这个问题 的问题 问题 答案 回答 请问 答 问 youasked yourquestionis yourquestionwas thequestionis thequestionwas question answer regarding".split()
REFUSAL = (
    "(不能|无法|不便|恕难|难以|拒绝|不提供|不会|无权|没有资格|不具备|超出).{0,14}(回答|作答|解答|答复|提供|意见|处理|请求|内容|判断|诊断|资格|范围|问题)"
    "|不提供此类|cannot (help|answer|assist|provide|discuss|respond)|can'?t (help|answer|assist|provide|discuss|respond)|unable to (give|help|answer|provide|assist|respond)|not able to (give|help|answer|provide|assist|respond)|must decline|have to decline|no response can be provided|outside what i can|not qualified to"
)
COURTESY = (
    "^(很)?(抱歉|对不起|遗憾|您好|你好|谢谢|感谢.*)$|^作为.{0,8}(助手|模型|系统)$|谅解|建议.{0,6}(医院|就诊|医师|医生)|咨询.{0,8}(医师|医生|专业)|换一个问题|我已(看到|收到|知悉)|理解您"
    "|^(i'?m |i am |we are )?(very |so )?(sorry|afraid)( but)?$|^unfortunately$|^as an? .{0,24}(assistant|model|system)$|please (ask|consult|see|contact|try)|you (may|can|could) (ask|try|consult)|another question|^(but|and|so|hello|hi|thank you.*)$|i (have )?(seen|received|understand|noted)|your question"
)
#: Words that tell the Latin-script languages apart.
_STOPWORDS = {
    "en": "the of and is are was were in with to for that by on as at be this from which or not when has have",
    "de": "der die das und ist sind war im mit zu für den dem des eine einen bei nach nicht auf als von oder wobei",
    "fr": "le la les et est sont dans avec pour du des une un au par sur que qui ou pas en aux ce",
}
#: How a question names the language it wants; checked in lower case.
_ASKS = {"en": "英文|英语|英譯|译成英|english", "zh": "中文|汉语|chinese", "de": "德文|德语|german", "fr": "法文|法语|french", "ja": "日文|日语|japanese", "hi": "印地|hindi", "th": "泰文|泰语|thai"}


#: Without any of these an answer is a term and no sentence; particles and predicates.
_FUNCTION_HAN = "[的是为有和与及或而但则其这该呈着了被把将可能会应宜须于时若如未不无较见且因占由从至等在约成若便中]|[はがをにでのともた]|ที่|และ|ใน|มี|จาก|กับ|ของ|เพื่อ|ว่า|เมื่อ|พบ|ให้|ควร"
_FUNCTION_HINDI = r"(?:^|\s)(?:में|है|हैं|और|के|की|का|से|को|या|एक|पर|यह|तथा|न|नहीं)(?:\s|$)"


def plain(text: Column) -> Column:
    """Without markup, list marks and labels of an answer."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^<>]*>", " ")
    t = F.regexp_replace(t, r"(?U)[*_`#]+", "")
    return F.regexp_replace(t, r"(?Ui)^\s*(答案|回答|答|answer|a)\s*[:：]\s*", "")


def letters(text: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\p{M}]+", "")


def language(text: Column) -> Column:
    """The main language: of a script of its own, or among Latin ones by their small words; null without letters."""
    low = F.lower(F.coalesce(text, F.lit("")))
    han = F.regexp_count(low, F.lit(r"\p{IsHan}"))
    kana = F.regexp_count(low, F.lit(r"[\p{IsHiragana}\p{IsKatakana}]"))
    thai = F.regexp_count(low, F.lit(r"\p{IsThai}"))
    hindi = F.regexp_count(low, F.lit(r"\p{IsDevanagari}"))
    latin = F.regexp_count(low, F.lit(r"[\p{IsLatin}][\p{IsLatin}0-9-]*"))
    best = {lang: F.regexp_count(low, F.lit(r"(?<![\p{L}])(" + "|".join(words.split()) + r")(?![\p{L}])")) for lang, words in _STOPWORDS.items()}
    accents = F.regexp_count(low, F.lit("[äöüß]")) , F.regexp_count(low, F.lit("[éèêàçùœ]"))
    de, fr = best["de"] + accents[0], best["fr"] + accents[1]
    latin_language = F.when((de > best["en"]) & (de > fr), "de").when((fr > best["en"]) & (fr >= de), "fr").otherwise("en")
    # a Latin word weighs as much as two Han characters
    return (
        F.when(han + kana + thai + hindi + latin == 0, None)
        .when(thai / 4 > F.greatest(han / 2, latin), "th")
        .when(hindi / 4 > F.greatest(han / 2, latin), "hi")
        .when((kana * 4 > han) & ((han + kana) / 2 >= latin), "ja")
        .when(han / 2 >= latin, "zh")
        .otherwise(latin_language)
    )


def judged_pairs(pairs: DataFrame) -> DataFrame:
    """Adds ``defect`` (null, or one of the kinds that a pair shows by itself) to distinct pairs."""
    q, a = F.coalesce(F.col("question"), F.lit("")), F.coalesce(F.col("answer"), F.lit(""))
    df = pairs.withColumn("plain", plain(F.col("answer"))).withColumn("aa", letters(F.col("plain"))).withColumn("qq", letters(q))
    squeezed = F.lower(F.regexp_replace(F.col("plain"), r"(?U)[\s\p{P}&&[^/]]+", ""))
    empty = (F.col("aa") == "") | squeezed.isin(PLACEHOLDERS) | F.col("aa").isin([re.sub(r"\W", "", p) for p in PLACEHOLDERS])

    frames = "|".join(sorted(FRAMES, key=len, reverse=True))
    unframed = F.regexp_replace(F.regexp_replace(F.col("aa"), f"^({frames})+", ""), f"({frames})+$", "")
    bare_q = F.regexp_replace(F.col("qq"), f"^({frames})+", "")
    size = F.length("qq")
    near = (F.abs(F.length(unframed) - F.length(bare_q)) <= F.greatest(F.lit(2), size / 5)) & (F.levenshtein(unframed, bare_q) <= F.greatest(F.lit(2), size / 5))
    left_over = F.regexp_replace(F.replace(F.col("aa"), F.col("qq"), F.lit("\u0001")), f"\u0001|{frames}", "")
    copy = (size >= 6) & (near | (F.contains("aa", F.col("qq")) & (left_over == "")))

    clauses = F.filter(F.transform(F.split(F.lower("plain"), r"[，。！？；!?;]|[,.](?=\s|$)|\n"), lambda c: F.regexp_replace(F.trim(c), "[’]", "'")), lambda c: c != "")
    df = df.withColumn("clauses", clauses)
    polite = F.forall("clauses", lambda c: c.rlike(REFUSAL) | c.rlike(COURTESY))
    refusal = polite & F.exists("clauses", lambda c: c.rlike(REFUSAL))

    df = df.withColumn("q_lang", language(q)).withColumn("a_lang", language(F.col("plain")))
    asked = F.coalesce(*[F.when((F.col("a_lang") == lang) & F.lower(q).rlike(words), True) for lang, words in _ASKS.items()], F.lit(False))
    # a code or a few names are of no language
    sentence = (F.regexp_count(F.lower("plain"), F.lit(r"[\p{IsLatin}][\p{IsLatin}0-9'-]{2,}")) >= 4) | (F.regexp_count("plain", F.lit(r"[\p{IsHan}\p{IsHiragana}\p{IsThai}\p{IsDevanagari}]")) >= 4)
    other = F.col("q_lang").isNotNull() & F.col("a_lang").isNotNull() & (F.col("q_lang") != F.col("a_lang")) & ~asked & sentence
    defect = F.when(empty, "empty").when(copy, "copy").when(refusal, "refusal").when(other, "other_language")
    return df.select("record_kind", "record_id", "question", "answer", "a_lang", defect.alias("defect"))


_SPLIT = re.compile(r"(?<=[。！？!?।])[”’」』»\"）)]*|(?<=\.)[”\"»“]*\s+|\n+")
_CLAUSE = re.compile(r"[，；、：;:]|,(?=\s|$)")
_END = re.compile(r"[。！？!?।.][”’」』»“\"）)\]]*$")
_DANGLING = re.compile(r"[，、；：,;:（(“「『«\[【-]$|[①-⑳]$|(…|\.\.\.)[”\"）)]*$|(?<![0-9.])0\.$")
_WORDLIKE = re.compile(r"\w")
_OPENERS = {"（": "）", "(": ")", "“": "”", "「": "」", "『": "』", "«": "»", "„": "“", "【": "】"}


def _masked(s: str) -> str:
    return re.sub(r"[0-9]+(?:\.[0-9]+)*", "9", s)


def _open_bracket(text: str) -> bool:
    for a, b in _OPENERS.items():
        opened = text.count(a)
        if opened and opened > text.count(b) and not (a == "“" and "„" in text):
            return True
    return False


def clause_keys(clause: str, sentence_start: str, number: int, latin: bool) -> list[str]:
    """The statistics a clause end belongs to; the first three from the longest to the shortest."""
    c = _masked(clause.strip())
    if latin:
        words = c.lower().split()
        ends = ["e3:" + " ".join(words[-3:]), "e2:" + " ".join(words[-2:]), "e1:" + " ".join(words[-1:])]
        first = " ".join(words[:2])
    else:
        ends = ["e3:" + c[-4:], "e2:" + c[-3:], "e1:" + c[-2:]]
        first = c[:1]
    return [*ends, "c:" + first, f"f:{_masked(sentence_start)[:3]}#{number}"]


def clauses_of(text: str) -> Iterator[tuple[str, list[str], bool, bool]]:
    """Each clause with its keys, whether it ends a sentence, and whether it is the last one of an answer without an end mark."""
    latin = len(re.findall(r"[A-Za-zÀ-ÿऀ-ॿ]", text)) > 0.5 * max(1, len(re.sub(r"[\W\d_]", "", text)))
    listed = bool(re.search(r"(^|\n)\s*[0-9]+[.)]\s", text))
    sentences = [s for s in _SPLIT.split(text) if s and s.strip()]
    for k, s in enumerate(sentences):
        last = k == len(sentences) - 1
        s = re.sub(r"^\s*(?:[0-9]+[.)]|[①-⑳])\s*", "", s.strip())
        done = bool(_END.search(s)) or (listed and not last)
        body = re.sub(r"[。！？!?।.”’」』»“\"]+$", "", s)
        parts = [p for p in _CLAUSE.split(body) if p.strip()]
        for n, p in enumerate(parts):
            p = re.sub(r"^[①-⑳“”「」\"\s]+", "", p)
            if p:
                final = n == len(parts) - 1
                yield p, clause_keys(p, s, n + 1, latin), final and done, final and last and not done


def _unit(kind: str, text: str) -> str:
    return kind + " " + re.sub(r"[\W_]+$", "", text)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(key, at_end)``: a row for each clause end and statistic, for each clause (``c``) and for each whole answer (``w``), without marks at their ends."""
    for batch in batches:
        keys, ends = [], []
        for text, ending in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            keys.append(_unit("w", text))
            ends.append(int(ending != "open"))
            for p, names, at_end, cut_off in clauses_of(text):
                if not cut_off:
                    keys.extend(names)
                    ends.extend([int(at_end)] * len(names))
                keys.append(_unit("c", _masked(p)))
                ends.append(int(at_end))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ends, pa.int64())], ["key", "at_end"])


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(answer_id, key)`` of the last clause of each answer without an end mark, and of the answer as a whole."""
    for batch in batches:
        keys, ids = [], []
        for r, text in enumerate(batch.column(1).to_pylist()):
            mine = [_unit("w", text)]
            for p, names, _, cut_off in clauses_of(text):
                if cut_off:
                    mine += [*names, _unit("c", _masked(p))]
            keys.extend(mine)
            ids.extend([r] * len(mine))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(keys, pa.string())], ["answer_id", "key"])


def _broken_off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How an answer ends: ``broken`` for certain, ``open`` without an end mark, else ``ended``."""
    for batch in batches:
        out = []
        for text in batch.column(1).to_pylist():
            t = text.rstrip()
            if _DANGLING.search(t) or _open_bracket(t):
                out.append("broken")
            else:
                out.append("ended" if _END.search(t) else "open")
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "ending"])


def is_term(text: Column) -> Column:
    """One clause without any function word."""
    low = F.lower(text)
    latin = r"(?<![\p{L}])(" + "|".join(sorted({w for words in _STOPWORDS.values() for w in words.split()})) + r")(?![\p{L}])"
    return ~text.rlike(r"[，；、：;:\n]|,(?=\s|$)") & ~low.rlike(f"{_FUNCTION_HAN}|{_FUNCTION_HINDI}|{latin}")


def continued(units: DataFrame) -> DataFrame:
    """Every ``unit`` of the distinct ones that its successor in sorted order continues.

    Of all units that begin with a given one, if there are any, one follows it directly.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, first, last = TaskContext.get().partitionId(), None, None
        for batch in batches:
            names = batch.column(0).to_pylist()
            if names and first is None:
                first = names[0]
            found = [a for a, b in zip([last, *names], names, strict=False) if a is not None and b.startswith(a)]
            last = names[-1] if names else last
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(found), pa.int32()), pa.array(found, pa.string()), pa.array([None] * len(found), pa.string())], ["part", "unit", "first"])
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([last], pa.string()), pa.array([first], pa.string())], ["part", "unit", "first"])

    seen = units.orderBy("unit").mapInArrow(run, "part int, unit string, first string")
    # one row a partition that holds any unit
    edges = seen.where("first IS NOT NULL").withColumn("next", F.lead("first").over(Window.orderBy("part")))
    return seen.where("first IS NULL").select("unit").union(edges.where("startswith(next, unit)").select("unit"))


def length_spikes(open_answers: DataFrame, least: int = 20, factor: int = 8) -> DataFrame:
    """Lengths at which far more answers without an end mark stop than at the ten lengths around."""
    counts = open_answers.groupBy(F.length("text").alias("size")).agg(F.count("*").alias("n"))
    around = counts.select(F.explode(F.array(*[F.col("size") + d for d in range(-5, 6) if d])).alias("size"), F.col("n").alias("near")).groupBy("size").agg((F.sum("near") / 10).alias("near"))
    return counts.join(around, "size", "left").where((F.col("n") >= least) & (F.col("n") >= factor * (F.coalesce("near", F.lit(0.0)) + 1))).select("size")


def analyse(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The judged pairs, and ``(answer_id, rules)`` of truncated answers with the rules that say so."""
    rows = pairs.select("record_kind", F.col("record_id").cast("string").alias("record_id"), "question", "answer").distinct()
    judged = cut_lineage(judged_pairs(rows))
    texts = judged.where("defect IS NULL").select(F.col("answer").alias("text")).distinct().select(F.xxhash64("text").alias("answer_id"), "text")
    ending = cut_lineage(texts.mapInArrow(_broken_off, "answer_id long, text string, ending string"))
    texts = ending.select("answer_id", "text")
    # answers that certainly broke off say nothing about how sentences end
    stats = cut_lineage(ending.where("ending != 'broken'").mapInArrow(_counted, "key string, at_end long").groupBy("key").agg(F.sum("at_end").alias("ends"), F.count("*").alias("n")))
    still_open = ending.where((F.col("ending") == "open") & ~is_term(F.col("text"))).select("answer_id", "text")
    keys = cut_lineage(still_open.mapInArrow(_looked_up, "answer_id long, key string").join(stats, "key", "left"))
    n = {k: F.coalesce(F.max(F.when(F.startswith("key", F.lit(k + ":")), F.col("n"))), F.lit(0)) for k in ("e3", "e2", "e1", "c", "f")}
    ends = {k: F.coalesce(F.max(F.when(F.startswith("key", F.lit(k + ":")), F.col("ends"))), F.lit(0)) for k in n}
    seen = keys.groupBy("answer_id").agg(*[v.alias("n_" + k) for k, v in n.items()], *[v.alias("ends_" + k) for k, v in ends.items()])
    by_suffix = F.when(F.col("n_e3") >= 3, F.col("ends_e3") * 50 < F.col("n_e3")).when(F.col("n_e2") >= 3, F.col("ends_e2") * 50 < F.col("n_e2")).otherwise(F.col("ends_e1") * 50 <= F.col("n_e1"))
    never = seen.where(by_suffix | ((F.col("n_c") >= 20) & (F.col("ends_c") == 0)) | ((F.col("n_f") >= 20) & (F.col("ends_f") == 0)))
    spiked = still_open.join(length_spikes(still_open), F.length("text") == F.col("size"), "left_semi")
    shortened = continued(stats.where("substring(key, 2, 1) = ' '").select(F.col("key").alias("unit")))
    shorter = keys.where("ends = 0").join(shortened, F.col("key") == F.col("unit"), "left_semi").select("answer_id").distinct()
    # a clause that no sentence ended with so far may still be a whole one, if its last words often end sentences
    shorter = shorter.join(seen, "answer_id").where(F.col("ends_e1") * 4 < F.greatest(F.col("n_e1"), F.lit(4)))
    rules = {"broken": ending.where("ending = 'broken'"), "neighbour": shorter, "spike": spiked, "statistics": never}
    truncated = reduce(DataFrame.union, [rows.select("answer_id", F.lit(rule).alias("rule")) for rule, rows in rules.items()])
    return judged, truncated.groupBy("answer_id").agg(F.array_sort(F.collect_set("rule")).alias("rules"))


def defects(pairs: DataFrame) -> DataFrame:
    """``(record_kind, record_id, defect_type)`` of the defective pairs of ``(record_kind, record_id, question, answer)``."""
    judged, truncated = analyse(pairs)
    plain_ones = judged.where("defect IS NOT NULL").select("record_kind", "record_id", F.col("defect").alias("defect_type"))
    cut = judged.where("defect IS NULL").withColumn("answer_id", F.xxhash64("answer")).join(truncated, "answer_id", "left_semi").select("record_kind", "record_id", F.lit("truncated").alias("defect_type"))
    return plain_ones.union(cut).distinct()


def project_pairs(questions: DataFrame, responses: DataFrame) -> DataFrame:
    a = questions.select(F.lit("question").alias("record_kind"), F.col("id").alias("record_id"), "question", F.col("expected_answer").alias("answer"))
    b = responses.select(F.lit("response").alias("record_kind"), F.col("query_id").alias("record_id"), "question", "answer")
    return a.unionByName(b)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return defects(project_pairs(table(spark, folder, "questions"), table(spark, folder, "responses")))


QUERIES = {"p5_found": p5_found}
