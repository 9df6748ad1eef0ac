"""Repair text that was extracted from scanned pages.

The contents are split into lines, the lines are classified, and windows over each document's lines
connect a line with the running text before and after it:

* headers: digits and numerals of short lines are masked; a masked line is a header if it recurs in ``RECURS`` documents
  or more between ever different lines (copies of one document share their lines' neighbours), or if it is, but for
  one damaged character, lost or widened spaces, letter case or a cut end, a title of a document or of a book;
* page numbers: lines whose digits (after undoing digit look-alikes) give the page or one of the next;
* cut words: the parts on both sides of a mark at a line end, joined with and without a hyphen, are
  looked up in the vocabulary of the reference texts; the more frequent form wins;
* misread characters: words are grouped by a skeleton in which confusable glyphs coincide; a form that
  the reference texts hardly have, in a group that has a frequent form, is misread, and so is a form that they never have
  between its neighbours where they have another of the group; the form with most support from its neighbours replaces it. Han characters
  are grouped by confusable glyphs as well; they have no words between spaces, so there the unit is the glyph with its two neighbours.

Reference texts are the contents of the collections that do not come from scanned pages.

Scale: only scanned contents are exploded into lines; vocabularies are aggregated on the map side and
joined as distributed tables; windows are partitioned by document. Titles and recurring lines meet the lines in an equi-join on
halves of their masked forms, of which one stays intact if one character is damaged. Nothing is collected.

Edge cases: null contents give no lines, empty contents one blank line; a document without titles or
page number is judged by form alone; repeated rows count once; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.session import cut_lineage
from quillspark.sources.tables import table

SCANNED = "atlas_scan"
#: A masked line that stands in so many documents between different lines is a running header.
RECURS = 4
#: Larger tables of forms are joined by shuffle.
BROADCAST_ROWS = 50_000

# Han glyphs that are taken for each other, and glyphs that fall apart into two.
HAN_CONFUSABLE = "胞胸 核孩 质庆 液夜 腺膝 织只 片爿 巴已色己 右石 大太 性牲 戒戎 议仪 气乞 梭棱 鳞磷 毛手 粒拉 本木未末 直真 景影 入人 日曰 土士 干千 侧测 处外 各名 若苦 间问 圆园 状壮 染柒"
HAN_SPLITS = {"肺": "月市"}
#: Glyphs that stand for an unreadable character.
UNREADABLE = "□◇■�囗"
#: Marks that a cut leaves at the end of a line.
CUT_MARKS = "-­‐¬"

_CUT_END = rf"[{CUT_MARKS}]\s*$"
_GROUPS = HAN_CONFUSABLE.split()
_ANY_CLASS = "[" + "".join(_GROUPS) + "".join(HAN_SPLITS) + "]"
_GLYPH = "(?:[" + "".join(_GROUPS) + "]|" + "|".join(HAN_SPLITS.values()) + ")"
_WORD = r"[a-z0-9]+(?:[.'/][a-z0-9]+)*"


def skeleton(word: Column) -> Column:
    """Lower-case form in which confusable Latin glyphs and digits coincide."""
    w = F.regexp_replace(word, "(?<=[a-z])I(?=[a-z]|$)", "l")
    w = F.translate(F.lower(w), "015|qeh", "olslgcb")
    for pair, glyph in (("rn", "m"), ("in", "m"), ("cl", "d"), ("li", "b"), ("vv", "w")):
        w = F.replace(w, F.lit(pair), F.lit(glyph))
    return w


def skeletons(word: Column) -> Column:
    """Both skeletons of a word: ``lin`` may have become ``lm`` or ``hn``, which one order of the glyph pairs cannot serve."""
    first = F.replace(F.translate(F.regexp_replace(word, "(?<=[a-z])I(?=[a-z]|$)", "l"), "01", "ol"), F.lit("li"), F.lit("h"))
    return F.array_distinct(F.array(F.concat(F.lit("a:"), skeleton(word)), F.concat(F.lit("b:"), skeleton(first))))


def squeezed(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"(?U)\s+", ""))


def _number(c: Column) -> Column:
    """The value of digits, full-width digits and digit look-alikes; null if there are none."""
    digits = F.regexp_replace(F.translate(c, "０１２３４５６７８９lIOo", "01234567891100"), "[^0-9]", "")
    return F.when(F.length(digits).between(1, 6), digits.cast("int"))


def reference_counts(texts: DataFrame) -> DataFrame:
    """``(key, n, kind, skel, skels)``: words, neighbouring words, hyphenated neighbours and Han glyphs with both neighbours, over the ``content`` of ``texts``."""
    low = F.lower(F.col("content"))
    flat = F.regexp_replace(F.col("content"), r"(?U)\s+", "")
    none = F.array().cast("array<string>")
    any_split = reduce(lambda a, b: a | b, [F.contains(flat, F.lit(split)) for split in HAN_SPLITS.values()])
    rows = texts.select(F.regexp_extract_all(low, F.lit(_WORD), F.lit(0)).alias("words"), F.when(F.contains(low, F.lit("-")), F.regexp_extract_all(low, F.lit(r"(?=\b([a-z]+-[a-z]+))"), F.lit(1))).otherwise(none).alias("hyphenated"), F.regexp_extract_all(flat, F.lit(f"(?=(.{_ANY_CLASS}.))"), F.lit(1)).alias("glyphs"), F.when(any_split, F.regexp_extract_all(flat, F.lit(f"(?=(.(?:{'|'.join(HAN_SPLITS.values())}).))"), F.lit(1))).otherwise(none).alias("splits"))
    pairs = F.zip_with("words", F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    keys = F.concat("words", F.filter(pairs, lambda p: p.isNotNull()), "hyphenated", "glyphs", "splits")
    counts = rows.select(F.explode(keys).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    kind = F.when(F.contains("key", F.lit(" ")), "pair").when(F.col("key").rlike(r"\p{IsHan}"), "glyph").when(F.contains("key", F.lit("-")), "hyphenated").otherwise("word")
    worded = F.col("kind").isin("word", "hyphenated")
    return counts.withColumn("kind", kind).withColumn("skel", F.when(worded, skeleton(F.col("key")))).withColumn("skels", F.when(F.col("kind") == "word", skeletons(F.col("key"))))


def masked(title: Column) -> Column:
    """Squeezed, with digits and Chinese numerals masked."""
    return F.regexp_replace(F.regexp_replace(squeezed(title), "[0-9０-９]+", "9"), "第[一二三四五六七八九十百零9]+", "第9")


def title_forms(records: DataFrame, toc: DataFrame) -> DataFrame:
    """``form``: titles of the records and of the books, masked and as they are (a damaged first character keeps a numeral from being masked)."""
    names = [rows.select(F.explode(F.array(*columns)).alias("title")) for rows, columns in ((records, ("chapter_title", "section_title")), (toc, ("book_title", "chapter_title", "section_title")))]
    return reduce(DataFrame.union, names).where("title IS NOT NULL").distinct().select(F.explode(F.array_distinct(F.array(masked(F.col("title")), squeezed(F.col("title"))))).alias("form")).where("form != ''").distinct()


def recurring_forms(lines: DataFrame) -> DataFrame:
    """``form``: masked lines without an end mark that stand in ``RECURS`` documents or more, each time between other lines.

    At least a quarter of them show a page number or stand beside one; a line of prose that recurs by its wording does not.
    """
    slim = lines.select("doc_id", "line_no", F.xxhash64("s").alias("s"), "is_number", (F.col("beside") != "").alias("numbered"), F.when(F.col("may_recur"), F.col("form")).alias("form"))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    paged = F.coalesce(F.lag("is_number").over(w), F.lit(False)) | F.coalesce(F.lead("is_number").over(w), F.lit(False)) | F.col("numbered")
    short = slim.withColumn("above", F.lag("s").over(w)).withColumn("below", F.lead("s").over(w)).withColumn("paged", paged.cast("int")).where("form IS NOT NULL")
    seen = short.groupBy("form", "doc_id", "above", "below").agg(F.max("paged").alias("paged"))
    seen = seen.groupBy("form").agg(*[F.count_distinct(c).alias(c) for c in ("doc_id", "above", "below")], F.avg("paged").alias("paged"))
    return seen.where((F.col("doc_id") >= RECURS) & (F.col("above") >= RECURS) & (F.col("below") >= RECURS) & (F.col("paged") >= 0.25)).select("form")


def _same_title(line: Column, title: Column) -> Column:
    """Whether a masked line is the masked title, maybe with one damaged character or a cut end."""
    n, m = F.length(line), F.length(title)
    near = (n >= 4) & (F.abs(n - m) <= 1) & (F.levenshtein(line, title) <= 1)
    cut = (n >= 3) & (n <= m + 1) & line.endswith("…") & (F.levenshtein(F.substring(title, F.lit(1), n - 1), F.substring(line, F.lit(1), n - 1)) <= F.when(n > 6, 1).otherwise(0))
    return (m > 0) & ((line == title) | near | cut)


def header_lines(forms: DataFrame, titles: DataFrame) -> DataFrame:
    """The distinct line forms that are one of the titles; they meet by a half that one damaged character leaves intact."""
    tag = lambda kind, c: F.xxhash64(F.lit(kind), c)
    m, n = F.length("title"), F.length("form")
    half = F.floor(m / 2).cast("int")
    prefixes = F.transform(F.sequence(F.lit(1), m), lambda k: tag("cut:", F.substring("title", F.lit(1), k)))
    keys = F.concat(F.array(tag("left:", F.substring("title", F.lit(1), half)), tag("right:", F.substring("title", half + 1, m))), prefixes)
    known = titles.select(F.col("form").alias("title")).select("title", F.explode(F.array_distinct(keys)).alias("key"))
    sizes = F.array(n - 1, n, n + 1)
    left = F.transform(sizes, lambda k: tag("left:", F.substring("form", F.lit(1), F.floor(k / 2).cast("int"))))
    right = F.transform(sizes, lambda k: tag("right:", F.substring("form", F.greatest(n - (k - F.floor(k / 2).cast("int")) + 1, F.lit(1)), n)))
    # the part before a cut end: its first half, or as a whole where it is too short for a damaged character
    start = F.when(n - 1 > 6, F.floor((n - 1) / 2).cast("int")).otherwise(n - 1)
    mine = F.when(F.col("form").endswith("…") & (n > 2), F.array(tag("cut:", F.substring("form", F.lit(1), start)))).otherwise(F.array().cast("array<long>"))
    asked = forms.select("form", F.explode(F.array_distinct(F.concat(left, right, mine))).alias("key"))
    return asked.join(known, "key").where(_same_title(F.col("form"), F.col("title"))).select("form").distinct()


def classify_lines(records: DataFrame, titles: DataFrame) -> DataFrame:
    """One row per line of the scanned records, with its kind and the running text around it."""
    own_titles = (("t1", masked, "chapter_title"), ("t2", masked, "section_title"), ("t3", squeezed, "chapter_title"), ("t4", squeezed, "section_title"))
    titled = records.select("doc_id", "page_number", "content", *[f(F.coalesce(t, F.lit(""))).alias(k) for k, f, t in own_titles])
    lines = titled.select("doc_id", "page_number", "t1", "t2", "t3", "t4", F.posexplode(F.split("content", "\n")).alias("pos", "raw"))
    s = F.btrim(F.regexp_replace(F.col("raw"), "[\\r ]", ""), F.lit(" \t　"))
    core = F.regexp_replace(s, r"^[※◆|·•◇■□\s]+|[※◆|·•\s]+$", "")
    lines = lines.select("doc_id", "page_number", F.col("pos").alias("line_no"), F.col("raw").rlike("^　").alias("indented"), s.alias("s"), core.alias("core"), "t1", "t2", "t3", "t4")
    lines = lines.withColumn("line_no", F.col("line_no") + 1)

    glyph = "[0-9０-９lIOo]"
    before, after = rf"^({glyph}{{1,4}})\s{{2,}}(?=\S)", rf"(?:\s{{2,}}|\s*·\s*)({glyph}{{1,4}})$"
    rest = F.regexp_replace(F.regexp_replace("core", before, ""), after, "")
    lines = lines.withColumn("form0", masked(F.col("core"))).withColumn("form", masked(F.regexp_replace(rest, r"[※◆|·•\s]+$", "")))
    lines = lines.withColumn("beside", F.concat(F.regexp_extract("core", before, 1), F.regexp_extract("core", after, 1)))

    plausible = (F.length("core").between(3, 160)) & ~F.col("s").rlike(r"^#{1,6}\s") & ~F.col("core").rlike("[。；！？;!?]")
    lines = lines.withColumn("plausible", plausible)
    own = reduce(lambda a, b: a | b, [_same_title(F.col(h), F.col(t)) for h in ("form", "form0") for t in ("t1", "t2", "t3", "t4")])
    lines = lines.withColumn("own_title", own)

    bare = F.col("core").rlike(rf"^{glyph}{{1,4}}$") & F.col("core").rlike(r"[0-9０-９]|^[lIO]{2,4}$")
    marks = r"\s\-—–·•.|\[\]〔〕()（）【】※◆"
    dressed = F.col("s").rlike(rf"^[{marks}]*(?:[Pp]\.?|[Pp]age|第)?[{marks}]*{glyph}(?:\s?{glyph}){{0,3}}\s*(?:页|/\s*{glyph}{{1,4}})?[{marks}]*$") & F.col("s").rlike(r"[0-9０-９]|[lIO]{2}")
    shown = _number(F.regexp_replace("s", r"/.*$", ""))
    near = (F.col("shown") >= F.col("page_number") - 1) & (F.col("shown") <= F.col("page_number") + 3)
    plain = F.col("s").rlike("^[0-9]{1,6}$")
    lines = lines.withColumn("is_number", F.col("s").rlike(r"^[0-9.,]{1,8}$") | bare | dressed).withColumn("shown", F.when(F.col("is_number"), shown)).withColumn("plain", plain)
    # a header of no title: no end mark, no clause mark
    recurs = ~F.col("is_number") & ~F.col("core").rlike(r"[,，:：]|、$|\.(\s|$)") & (F.length("form") >= 4)
    open_line = F.col("plausible") & ~F.col("own_title")
    lines = lines.withColumn("may_recur", open_line & recurs).withColumn("form", F.when(open_line, F.col("form"))).withColumn("form0", F.when(open_line & (F.col("form0") != F.col("form")), F.col("form0")))
    lines = cut_lineage(lines.drop("core", "t1", "t2", "t3", "t4"))
    forms = lines.where("form IS NOT NULL").select("doc_id", "line_no", F.explode(F.array_compact(F.array("form", "form0"))).alias("form"))
    asked = forms.select("form").distinct()
    found = header_lines(asked, titles.union(recurring_forms(lines)).distinct())
    named = forms.join(found, "form", "left_semi").select("doc_id", "line_no").groupBy("doc_id").agg(F.collect_set("line_no").alias("named"))
    # by document, as the windows below are partitioned
    lines = lines.join(named, "doc_id", "left").withColumn("is_header", F.col("plausible") & (F.col("own_title") | F.coalesce(F.array_contains("named", F.col("line_no")), F.lit(False))))
    ahead = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(1, Window.unboundedFollowing)
    behind = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    solid = (F.col("s") != "") & ~F.col("is_header") & ~F.col("is_number")
    lines = lines.withColumn("lead_in", F.last(F.when(solid, F.col("s")), True).over(behind))
    listed = F.coalesce(F.col("lead_in").rlike("[:：]$"), F.lit(False))
    is_page = F.when(F.col("page_number").isNotNull(), near).otherwise(~(F.col("plain") & listed))
    lines = lines.withColumn("is_page", F.coalesce(F.col("is_number") & ~F.col("is_header") & is_page, F.lit(False)))
    beside = _number(F.col("beside"))
    beside_ok = F.when(F.col("page_number").isNotNull(), (beside >= F.col("page_number") - 1) & (beside <= F.col("page_number") + 3)).otherwise(beside.isNotNull())
    lines = lines.withColumn("page_beside", F.col("is_header") & F.coalesce(beside_ok, F.lit(False)) & (F.col("beside") != ""))
    lines = lines.withColumn("is_heading", F.col("s").rlike(r"^#{1,6}\s"))
    text = (F.col("s") != "") & ~F.col("is_heading") & ~F.col("is_header") & ~F.col("is_number")
    lines = lines.withColumn("is_text", text)
    lines = lines.withColumn("before", F.last(F.when(F.col("is_text"), F.col("s")), True).over(behind)).withColumn("after", F.first(F.when(F.col("is_text"), F.struct("line_no", "s")), True).over(ahead))
    # of the text before only the last character is needed, of the text behind the first, or all of it behind a cut word
    next_text = F.when(F.col("s").rlike(_CUT_END), F.col("after.s")).otherwise(F.left("after.s", F.lit(1)))
    return lines.select("doc_id", "line_no", "indented", "s", "is_header", "is_page", "page_beside", "is_heading", "is_number", "is_text", F.right("before", F.lit(1)).alias("text_before"), F.col("after.line_no").alias("next_no"), next_text.alias("next_text"))


_LEFT = rf"([\p{{L}}\p{{M}}\p{{N}}-]*\p{{L}})[{CUT_MARKS}]\s*$"
_RIGHT = r"^([\p{L}][\p{L}\p{M}\p{N}-]*)"


def cut_words(lines: DataFrame, counts: DataFrame) -> DataFrame:
    """Lines that end in a cut mark: the parts, the joined word and whether the mark was put there for the cut."""
    ends = lines.where(F.col("is_text") & F.col("s").rlike(_CUT_END)).select("doc_id", "line_no", F.regexp_extract("s", _LEFT, 1).alias("whole_left"), "next_no", F.regexp_extract(F.coalesce("next_text", F.lit("")), _RIGHT, 1).alias("whole_right"), F.regexp_extract("s", rf"([{CUT_MARKS}])\s*$", 1).alias("mark"), F.coalesce("next_text", F.lit("")).alias("next_line"))
    ends = ends.where("whole_left != '' AND mark != ''")
    ends = ends.withColumn("left", F.element_at(F.split("whole_left", "-"), -1)).withColumn("right", F.element_at(F.split("whole_right", "-"), 1))
    ends = ends.withColumn("joined", F.lower(F.concat("left", "right"))).withColumn("compound", F.lower(F.concat_ws("-", "left", "right")))
    by_skeleton = counts.where("kind IN ('word', 'hyphenated')").groupBy("skel").agg(F.max(F.struct("n", "key")).alias("best"))
    keys = ends.select("joined", "compound").distinct()
    looked = (
        keys.withColumn("skel", skeleton(F.col("joined"))).join(by_skeleton.select("skel", F.col("best.n").alias("n_joined"), F.col("best.key").alias("best_joined")), "skel", "left").drop("skel")
        .withColumn("skel", skeleton(F.col("compound"))).join(by_skeleton.select("skel", F.col("best.n").alias("n_compound")), "skel", "left").drop("skel")
    )
    ends = ends.join(looked, ["joined", "compound"])
    n1, n2 = F.coalesce("n_joined", F.lit(0)), F.coalesce("n_compound", F.lit(0))
    goes_on = (F.col("whole_right") != "") | (F.col("next_line") == "")
    soft = F.col("mark") != "-"
    return ends.withColumn("is_cut", F.when(soft, F.lit(True)).otherwise(goes_on & (n1 >= n2) & ~((n1 == 0) & F.col("right").rlike(r"^\p{Lu}"))))


def misread_words(lines: DataFrame, cuts: DataFrame, counts: DataFrame) -> DataFrame:
    """``(doc_id, line_no, wrong, right)`` of misread Latin words of running text."""
    known = counts.where("kind = 'word'").select("key", "n", "skels")
    best = known.select("key", "n", F.explode("skels").alias("skel")).groupBy("skel").agg(F.max(F.struct("n", "key")).alias("best"))
    starts = cuts.where("is_cut").select("doc_id", F.col("next_no").alias("line_no"), "whole_right").where("line_no IS NOT NULL")
    ends = cuts.where("is_cut").select("doc_id", "line_no", "whole_left")
    text = lines.where("is_text").select("doc_id", "line_no", "s").join(starts, ["doc_id", "line_no"], "left").join(ends, ["doc_id", "line_no"], "left")
    # of a cut word the parts next to the cut are judged together, below
    tail = F.concat(F.regexp_replace(F.element_at(F.split("whole_left", "-"), -1), "^$", "\u0000"), F.lit(rf"[{CUT_MARKS}]\s*$"))
    body = F.when(F.col("whole_left").isNotNull(), F.regexp_replace(F.col("s"), tail, F.lit(""))).otherwise(F.col("s"))
    head = F.concat(F.lit("^"), F.element_at(F.split("whole_right", "-"), 1))
    body = F.when(F.col("whole_right").isNotNull() & (F.col("whole_right") != ""), F.regexp_replace(body, head, F.lit(""))).otherwise(body)
    found = text.select("doc_id", "line_no", F.regexp_extract_all(body, F.lit(_WORD.replace("a-z", "A-Za-z")), F.lit(0)).alias("w"))
    at = lambda k: F.lower(F.coalesce(F.get("w", k), F.lit("")))
    spots = F.transform("w", lambda w, k: F.struct(at(k - 1).alias("before"), w.alias("wrong"), at(k + 1).alias("after")))
    words = cut_lineage(found.select("doc_id", "line_no", F.explode(spots).alias("x")).select("doc_id", "line_no", "x.*").where(F.col("wrong").rlike("[A-Za-z]")))
    cut = cuts.where("is_cut").select(F.lower("joined").alias("wrong")).distinct()
    forms = words.select("wrong").union(cut).distinct().withColumn("key", F.lower("wrong"))
    # a capital I inside a lower-case word is a misread l, whatever the vocabulary says of the lower-cased word
    odd_case = F.col("wrong").rlike("[a-z]I([a-z]|$)")
    owned = forms.join(known.select("key", F.col("n").alias("n_own")), "key", "left")
    judged = owned.withColumn("skel", F.explode(skeletons(F.col("wrong")))).join(best, "skel")
    own = F.when(odd_case, 0).otherwise(F.coalesce("n_own", F.lit(0)))
    judged = cut_lineage(judged.where((F.col("best.n") >= 3) & (own * 50 <= F.col("best.n")) & ((F.col("best.key") != F.col("key")) | odd_case)).groupBy("wrong").agg(F.max(F.struct("best.n", "best.key")).alias("best")).select("wrong", F.col("best.key").alias("right")))
    # numbers vary too much for a vocabulary: letters that look like digits among digits
    numbers = owned.where(F.col("wrong").rlike(r"^(?=.*[0-9])(?=.*[OlI])[0-9OlI]{2,}(\.[0-9OlI]+)*$|^[0-9OlI]+\.[0-9OlI]+$") & F.col("wrong").rlike("[OlI]") & F.col("n_own").isNull()).select("wrong", F.translate("wrong", "OlI", "011").alias("right"))
    judged = judged.union(numbers).groupBy("wrong").agg(F.max("right").alias("right"))
    whole = words.join(chosen_by_neighbours(words, owned, judged, known, counts), ["before", "wrong", "after"]).select("doc_id", "line_no", "wrong", "right")
    parts = cuts.where("is_cut").select("doc_id", "line_no", "next_no", F.lower("left").alias("l"), F.lower("right").alias("r"), F.lower("joined").alias("wrong")).join(judged, "wrong")
    left = parts.where("NOT startswith(right, l)").select("doc_id", "line_no", "wrong", "right")
    right = parts.where("NOT endswith(right, r) AND next_no IS NOT NULL").select("doc_id", F.col("next_no").alias("line_no"), "wrong", "right")
    return whole.union(left).union(right)


def small(rows: DataFrame) -> DataFrame:
    """Broadcast in joins if there are no more than ``BROADCAST_ROWS`` of the (written) rows."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def chosen_by_neighbours(words: DataFrame, owned: DataFrame, judged: DataFrame, known: DataFrame, counts: DataFrame) -> DataFrame:
    """``(before, wrong, after, right)``: what stands between its neighbours by mistake and the form of its skeleton that they support most.

    A form that is misread anyway (``judged``) is replaced by the supported form, or else by the most frequent one. Another known
    form counts as misread only if the reference texts never have it beside either neighbour, but the other form beside each.
    """
    forms = known.where("n >= 3").select(F.col("key").alias("y"), F.col("n").alias("n_y"), F.explode("skels").alias("skel"))
    rivals = owned.where(F.col("n_own").isNotNull()).select("wrong", "key", F.explode(skeletons(F.col("wrong"))).alias("skel")).join(forms, "skel").where("y != key").select("wrong", "y", "n_y")
    usual = judged.select("wrong", F.col("right").alias("usual"))
    pool = usual.join(owned.select("wrong", F.explode(skeletons(F.col("wrong"))).alias("skel")), "wrong").join(forms, "skel").where("y != lower(wrong)").select("wrong", "y", "n_y")
    pool = pool.union(usual.select("wrong", F.col("usual").alias("y"), F.lit(0).cast("long").alias("n_y"))).union(rivals).groupBy("wrong", "y").agg(F.max("n_y").alias("n_y"))
    pool = small(cut_lineage(pool))
    asked = words.select("before", "wrong", "after").join(pool, "wrong").distinct()
    low = F.lower("wrong")
    roles = F.array(*[F.struct(F.lit(name).alias("role"), F.concat_ws(" ", a, b).alias("key")) for name, a, b in (("bx", F.col("before"), low), ("xa", low, F.col("after")), ("by", F.col("before"), F.col("y")), ("ya", F.col("y"), F.col("after")))])
    pairs = counts.where("kind = 'pair'").select("key", "n")
    looked = asked.select("before", "wrong", "after", "y", "n_y", F.explode(roles).alias("q")).select("before", "wrong", "after", "y", "n_y", "q.role", "q.key").join(pairs, "key", "left")
    n = {role: F.coalesce(F.max(F.when(F.col("role") == role, F.col("n"))), F.lit(0)) for role in ("bx", "xa", "by", "ya")}
    seen = looked.groupBy("before", "wrong", "after", "y", "n_y").agg(*[c.alias(role) for role, c in n.items()]).join(usual, "wrong", "left")
    only = (F.col("bx") == 0) & (F.col("xa") == 0) & (F.col("by") >= 2) & (F.col("ya") >= 2)
    kept = seen.where(F.col("usual").isNotNull() | only)
    support = F.struct((F.col("by") + F.col("ya")).alias("a"), (F.col("y") == F.coalesce("usual", F.lit(""))).alias("b"), F.col("n_y").alias("c"), F.col("y").alias("d"))
    return small(cut_lineage(kept.groupBy("before", "wrong", "after").agg(F.max(support).alias("best")).select("before", "wrong", "after", F.col("best.d").alias("right"))))


def misread_han(lines: DataFrame, counts: DataFrame) -> DataFrame:
    """``(doc_id, line_no, wrong, right)``: a Han character between its neighbours, as it is and as it should be."""
    flat = F.regexp_replace("s", r"(?U)\s+", "")
    context = F.concat(F.coalesce("text_before", F.lit("^")), flat, F.coalesce(F.left("next_text", F.lit(1)), F.lit("$")))
    seen = lines.where("is_text").select("doc_id", "line_no", context.alias("context"))
    places = seen.select("doc_id", "line_no", F.explode(F.regexp_extract_all("context", F.lit(f"(?=(.{_GLYPH}.))"), F.lit(1))).alias("wrong"))
    tri = counts.where((F.col("kind") == "glyph") & F.col("key").rlike(f"^.(?:{_GLYPH}|[{''.join(HAN_SPLITS)}]).$"))
    # the sides alone: the glyph with its left, and with its right neighbour
    core = lambda c: F.expr(f"substring({c}, 2, length({c}) - 2)")
    l, x, r = F.substring("key", 1, 1), core("key"), F.expr("right(key, 1)")
    side = lambda kind, c: F.concat(F.lit(kind), c)
    tri = tri.withColumn("k", F.explode(F.array(side("b", F.col("key")), side("l", F.concat(l, x)), side("r", F.concat(x, r))))).groupBy("k").agg(F.sum("n").alias("n"))
    groups = {g: [o for o in group if o != g] for group in _GROUPS for g in group} | {split: [g] for g, split in HAN_SPLITS.items()}
    others = F.create_map(*[x for g, found in groups.items() for x in (F.lit(g), F.array(*[F.lit(o) for o in found]))])
    forms = places.select("wrong").distinct().withColumn("y", F.explode(others[core("wrong")]))
    l, x, r = F.substring("wrong", 1, 1), core("wrong"), F.expr("right(wrong, 1)")
    roles = F.array(*[F.struct(F.lit(name).alias("role"), key.alias("k")) for name, key in (("x", side("b", F.col("wrong"))), ("xl", side("l", F.concat(l, x))), ("xr", side("r", F.concat(x, r))), ("y", side("b", F.concat(l, F.col("y"), r))), ("yl", side("l", F.concat(l, F.col("y")))), ("yr", side("r", F.concat(F.col("y"), r))))])
    looked = forms.select("wrong", "y", F.explode(roles).alias("q")).select("wrong", "y", "q.role", "q.k").join(tri, "k", "left")
    n = {name: F.coalesce(F.max(F.when(F.col("role") == name, F.col("n"))), F.lit(0)).alias(f"n_{name}") for name in ("x", "xl", "xr", "y", "yl", "yr")}
    judged = looked.groupBy("wrong", "y").agg(*n.values())
    whole = (F.col("n_y") >= 3) & (F.col("n_x") * 20 <= F.col("n_y"))
    sides = (F.col("n_x") == 0) & (F.greatest("n_yl", "n_yr") >= 3) & (F.col("n_xl") * 20 <= F.col("n_yl")) & (F.col("n_xr") * 20 <= F.col("n_yr"))
    judged = judged.where(whole | sides).groupBy("wrong").agg(F.max_by("y", F.col("n_y") + F.col("n_yl") + F.col("n_yr")).alias("y"))
    return places.join(judged, "wrong").select("doc_id", "line_no", "wrong", F.concat(F.substring("wrong", 1, 1), F.col("y"), F.expr("right(wrong, 1)")).alias("right"))


def unreadable(lines: DataFrame) -> DataFrame:
    inside = rf"[\p{{L}}\p{{N}}，。；、][{UNREADABLE}]|[{UNREADABLE}][\p{{L}}\p{{N}}]"
    return lines.where(F.col("is_text") & F.col("s").rlike(inside)).select("doc_id", "line_no")


def analyse(records: DataFrame, toc: DataFrame, scanned: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The classified lines of the scanned records, their cut words and their misread words."""
    scanned = F.col("collection") == SCANNED if scanned is None else scanned
    present = records.where(F.col("content").isNotNull())
    rows = present.select(F.col("doc_id").cast("string").alias("doc_id"), "content", "page_number", "chapter_title", "section_title", F.coalesce(scanned, F.lit(False)).alias("scanned")).distinct()
    counts = cut_lineage(reference_counts(rows.where("NOT scanned").select("content")))
    lines = cut_lineage(classify_lines(rows.where("scanned").drop("scanned"), title_forms(present, toc)))
    cuts = cut_lineage(cut_words(lines, counts))
    return lines, cuts, misread_words(lines, cuts, counts).union(misread_han(lines, counts))


def noise(records: DataFrame, toc: DataFrame) -> DataFrame:
    """``(doc_id, line_no, noise_kind)``, one row per line and kind."""
    lines, cuts, wrong = analyse(records, toc)
    kinds = [
        lines.where("is_header").select("doc_id", "line_no", F.lit("running_header").alias("noise_kind")),
        lines.where("is_page OR page_beside").select("doc_id", "line_no", F.lit("page_number").alias("noise_kind")),
        cuts.where("is_cut").select("doc_id", "line_no", F.lit("hyphen_break").alias("noise_kind")),
        wrong.select("doc_id", "line_no", F.lit("misread").alias("noise_kind")),
        unreadable(lines).select("doc_id", "line_no", F.lit("misread").alias("noise_kind")),
    ]
    return reduce(DataFrame.unionByName, kinds).distinct()


def _fixed(text: Column, fix: Column) -> Column:
    """The text with one correction; of a Han character's neighbours one may stand on another line."""
    wrong, right = fix["wrong"], fix["right"]
    n, m = F.length(wrong), F.length(right)
    left = F.replace(text, F.substring(wrong, F.lit(1), n - 1), F.substring(right, F.lit(1), m - 1))
    rest = F.replace(text, F.substring(wrong, F.lit(2), n), F.substring(right, F.lit(2), m))
    edge = (n >= 3) & wrong.rlike("\\p{IsHan}") & ~F.contains(text, wrong)
    return F.when(edge & F.contains(text, F.substring(wrong, F.lit(1), n - 1)), left).when(edge, rest).otherwise(F.replace(text, wrong, right))


def repaired_paragraphs(records: DataFrame, toc: DataFrame) -> DataFrame:
    """``(doc_id, paragraph_no, text)``: readable paragraphs without headers, page numbers, cuts and misread words.

    A paragraph ends at a blank line, a heading or an indented line; where a header or page number stood,
    the paragraph goes on unless the text before it ended a sentence.
    """
    lines, cuts, wrong = analyse(records, toc)
    fixes = wrong.distinct().groupBy("doc_id", "line_no").agg(F.array_sort(F.collect_list(F.struct("wrong", "right"))).alias("fixes"))
    ends = cuts.where("is_cut").select("doc_id", "line_no", F.lit(True).alias("is_cut"))
    kept = lines.where("NOT is_header AND NOT is_page AND s != '' OR s = ''").join(fixes, ["doc_id", "line_no"], "left").join(ends, ["doc_id", "line_no"], "left")
    plain = F.aggregate(F.coalesce("fixes", F.array().cast("array<struct<wrong:string,right:string>>")), F.col("s"), _fixed)
    kept = kept.withColumn("fixed", F.when(F.col("is_cut"), F.regexp_replace(plain, rf"[{CUT_MARKS}]\s*$", "")).otherwise(plain))
    order = Window.partitionBy("doc_id").orderBy("line_no")
    kept = kept.withColumn("was_blank", F.lag(F.col("s") == "").over(order)).withColumn("was_heading", F.lag("is_heading").over(order))
    opens = F.col("was_blank") | F.col("was_heading") | F.col("is_heading") | F.col("indented")
    kept = kept.withColumn("paragraph_no", F.sum(F.coalesce(opens.cast("int"), F.lit(0))).over(order)).where("s != ''")
    latin = F.col("fixed").rlike(r"[\p{L}\p{N}.,;:!?)”\"]$") & ~F.col("fixed").rlike(r"\p{IsHan}$")
    piece = F.when(F.col("is_cut"), F.col("fixed")).when(latin, F.concat("fixed", F.lit(" "))).otherwise(F.col("fixed"))
    return kept.withColumn("piece", piece).groupBy("doc_id", "paragraph_no").agg(F.btrim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "piece"))), lambda x: x["piece"]), "")).alias("text"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return noise(table(spark, folder, "search_results"), table(spark, folder, "toc"))


def p1_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return repaired_paragraphs(table(spark, folder, "search_results"), table(spark, folder, "toc"))


QUERIES = {"p1_found": p1_found, "p1_paragraphs": p1_paragraphs}
