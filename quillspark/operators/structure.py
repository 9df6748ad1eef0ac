"""Titles, tables of contents, figures, images, phrases, embedded JSON and options inside texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: White space at both ends, for both engines.
ENDS = r"^[\s\x{3000}\x{a0}]+|[\s\x{3000}\x{a0}]+$"
# Words that introduce a list of features, and the numbers of chapters and sections.
FEATURE_LEADS = ["ROSE特征", "特征", "表现为", "可见", "细胞学特点"]
NUMBER = "[一二三四五六七八九十百千万0-9]"
IMAGE = r"!\[([^\[\]]*)\]\(([^()]*)\)"
OPTION_TYPES = ["hybrid", "keyword", "vector"]


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, ENDS, "")


def clean_title(title: Column) -> Column:
    """Without the first number, the marks before it and all behind it; then without marks at the end."""
    return stripped(F.regexp_replace(F.regexp_replace(title, r"[.．。·\s]*[0-9]+[^\n]*$", ""), r"[.．。·]+$", ""))


def section_name(title: Column) -> Column:
    """``第X节 title`` with a single space, other titles cleaned only."""
    cleaned = clean_title(F.regexp_replace(title, "^[# ]+", ""))
    head = F.regexp_extract(cleaned, f"^(第{NUMBER}+节)", 1)
    return F.when(head != "", stripped(F.concat(head, F.lit(" "), stripped(F.regexp_replace(cleaned, f"^第{NUMBER}+节", ""))))).otherwise(cleaned)


def figure_label(text: Column) -> Column:
    """The first of: a figure with chapter and number, a numbered figure, a figure numbered in Chinese."""
    found = [F.regexp_extract(text, p, 1) for p in (r"图\s*([0-9]+-[0-9]+[a-z]?)", r"图\s*([0-9]+[a-z]?)", r"图\s*([一二三四五六七八九十]+[a-z]?)")]
    return F.coalesce(*[F.when(f != "", f) for f in found])


def titles_in(content: Column) -> tuple[Column, Column]:
    """Chapter and section title in the first lines of a text, blank if there is none.

    The first of ten lines with a chapter or section number decides; failing that, the first of fifteen lines of 6 to 99
    characters that has one or is a marked heading.
    """
    lines = F.transform(F.slice(F.split(content, "\n"), 1, 15), stripped)
    numbered = lambda l: l.rlike(f"第{NUMBER}+[章节]")
    bare = lambda l: stripped(F.regexp_replace(l, "^#+|#+$", ""))
    first = F.try_element_at(F.filter(F.slice(lines, 1, 10), numbered), F.lit(1))
    second = F.try_element_at(F.filter(lines, lambda l: F.length(l).between(6, 99) & (numbered(l) | (l.startswith("#") & (bare(l) != "")))), F.lit(1))
    line = F.coalesce(first, second, F.lit(""))
    title = F.when(numbered(line), line).otherwise(bare(line))
    chapter = F.when(numbered(line), line.rlike(f"第{NUMBER}+章")).otherwise(F.contains(title, F.lit("章")))
    section = ~chapter & (numbered(line) | F.contains(title, F.lit("节")))
    return F.when(chapter, title).otherwise(""), F.when(section, title).otherwise("")


def feature_phrases(texts: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Distinct ``(id, phrase)``: what stands between commas after a leading word and a colon, 3 to 99 characters long."""
    found = F.concat(*[F.regexp_extract_all(text_column, F.lit(rf"{lead}[^\n]*?[:：]\s*([^\n]+)"), F.lit(1)) for lead in FEATURE_LEADS])
    parts = F.flatten(F.transform(found, lambda t: F.split(t, "，")))
    phrase = F.regexp_replace(stripped(F.col("part")), "[\"']", "")
    rows = texts.where(F.col(text_column).isNotNull()).select(F.col(id_column).alias("id"), F.explode(parts).alias("part")).select("id", phrase.alias("phrase"))
    return rows.where(F.length("phrase").between(3, 99)).distinct()


def embedded_json(text: Column) -> tuple[Column, Column]:
    """The JSON in a text and how it was found: the whole text, a fenced block, or from the first to the last brace; null and ``none``."""
    whole = stripped(text)
    fenced = F.regexp_extract(whole, r"(?s)```json\s*(\{.*?\})\s*```", 1)
    braced = F.regexp_extract(whole, r"(?s)(\{.*\})", 1)
    valid = lambda c: (c != "") & F.try_parse_json(c).isNotNull()
    how = F.when(valid(whole), "whole").when(valid(fenced), "fenced").when(valid(braced), "braced").otherwise("none")
    return F.when(how == "whole", whole).when(how == "fenced", fenced).when(how == "braced", braced), how


def inline_options(text: Column) -> Column:
    """``(question, top_k, search_type, model)``: options among the words of a question, taken out of it; unusable values leave the default."""
    words = F.filter(F.split(stripped(text), r"\s+"), lambda w: w != "")
    value = lambda key: F.try_element_at(F.transform(F.filter(words, lambda w: w.startswith(key + "=")), lambda w: F.regexp_replace(w, "^[^=]*=", "")), F.lit(-1))
    usable = F.try_element_at(F.filter(F.transform(F.filter(words, lambda w: w.startswith("search_type=")), lambda w: F.regexp_replace(w, "^[^=]*=", "")), lambda v: v.isin(OPTION_TYPES)), F.lit(-1))
    kept = F.filter(words, lambda w: ~w.rlike("^(top_k|search_type|model)="))
    return F.struct(F.array_join(kept, " ").alias("question"), F.coalesce(F.expr("1") * value("top_k").try_cast("int"), F.lit(5)).alias("top_k"), F.coalesce(usable, F.lit("hybrid")).alias("search_type"), F.coalesce(value("model"), F.lit("default")).alias("model"))


def contents_entries(lines: DataFrame) -> DataFrame:
    """``(id, chapter_no, section_no, title)`` from the lines of tables of contents; several entries may share a line, a chapter has section 0."""
    mark = "\x01"
    parts = F.filter(F.split(F.regexp_replace(F.regexp_replace("line", "^[# ]+", ""), f"(第{NUMBER}+[章节])", mark + "$1"), mark), lambda p: p.rlike(f"^第{NUMBER}+[章节]"))
    rows = lines.select("id", "pos", F.posexplode(parts).alias("at", "entry"))
    w = Window.partitionBy("id").orderBy("pos", "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_chapter = F.col("entry").rlike(f"^第{NUMBER}+章")
    rows = rows.withColumn("chapter_no", F.sum(is_chapter.cast("int")).over(w)).withColumn("is_chapter", is_chapter)
    inside = Window.partitionBy("id", "chapter_no").orderBy("pos", "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    title = F.when(F.col("is_chapter"), clean_title(F.col("entry"))).otherwise(section_name(F.col("entry")))
    return rows.select("id", "chapter_no", F.sum((~F.col("is_chapter")).cast("int")).over(inside).alias("section_no"), title.alias("title"))


def chunks_by_contents(lines: DataFrame, opens: str = r"^#+\s*目\s*录", closes: str = "^参考文献") -> DataFrame:
    """``(id, chapter_no, section_no, chapter, section, lines, chars)``: sections of a document named by its table of contents.

    ``lines`` is ``(id, pos, line)``. The table of contents stands between the lines that ``opens`` and ``closes`` match. What
    is before it is the preface. Behind it the n-th chapter heading (``#``) takes the n-th chapter title, its m-th section heading
    (``##``) the m-th section title, further ones their own text. Text between a chapter and its first section belongs to that
    section; in a chapter without sections in the contents it is a section named like the chapter; text in a chapter whose contents
    have sections, but that holds none, is dropped, as is text before the first chapter. Documents without these lines give no row.
    """
    w = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.withColumn("opened", F.max(F.col("line").rlike(opens).cast("int")).over(w))
    ends = (F.col("opened") == 1) & F.col("line").rlike(closes)
    rows = rows.withColumn("ends", ends).withColumn("closed", F.max(ends.cast("int")).over(w))
    toc = contents_entries(rows.where("opened = 1 AND closed = 0"))
    chapters = toc.where("section_no = 0").select("id", "chapter_no", F.col("title").alias("toc_chapter"))
    sections = toc.where("section_no > 0").select("id", "chapter_no", "section_no", F.col("title").alias("toc_section"))
    planned = sections.groupBy("id", "chapter_no").agg(F.count("*").alias("planned"))

    text = stripped(F.col("line"))
    body = rows.where("closed = 1 AND NOT ends").withColumn("is_chapter", text.rlike(f"^#\\s*第{NUMBER}+章")).withColumn("is_section", text.rlike(f"^##\\s*第{NUMBER}+节"))
    body = body.withColumn("chapter_no", F.sum(F.col("is_chapter").cast("int")).over(w))
    inside = Window.partitionBy("id", "chapter_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    body = body.withColumn("at", F.sum(F.col("is_section").cast("int")).over(inside)).where("chapter_no > 0")
    body = body.join(chapters, ["id", "chapter_no"], "left").join(planned, ["id", "chapter_no"], "left")
    own = F.col("planned").isNull()
    # in a chapter without planned sections the text before any heading is section 1 and the headings follow
    body = body.withColumn("section_no", F.when(own, F.col("at") + 1).otherwise(F.greatest("at", F.lit(1))))
    headings = body.where("is_section").groupBy("id", "chapter_no", "section_no").agg(F.min("line").alias("heading"))
    titles = body.where("is_chapter").groupBy("id", "chapter_no").agg(F.coalesce(F.min("toc_chapter"), clean_title(F.regexp_replace(F.min("line"), "^[# ]+", ""))).alias("chapter"))
    kept = body.where("NOT is_chapter AND NOT is_section").join(titles, ["id", "chapter_no"]).join(headings, ["id", "chapter_no", "section_no"], "left").join(sections, ["id", "chapter_no", "section_no"], "left")
    named = kept.where(F.col("heading").isNotNull() | F.col("planned").isNull())
    section = F.when(F.col("heading").isNull(), F.col("chapter")).otherwise(F.coalesce("toc_section", section_name(F.col("heading"))))
    solid = named.withColumn("section", section).groupBy("id", "chapter_no", "section_no", "chapter", "section").agg(F.count_if(stripped(F.col("line")) != "").alias("lines"), F.sum(F.length("line")).alias("chars"))
    preface = rows.where("opened = 0").join(rows.where("ends").select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.count_if(stripped(F.col("line")) != "").alias("lines"), F.sum(F.length("line")).alias("chars"))
    preface = preface.select("id", F.lit(0).cast("long").alias("chapter_no"), F.lit(0).cast("long").alias("section_no"), F.lit("前言").alias("chapter"), F.lit("前言").alias("section"), "lines", "chars")
    return solid.unionByName(preface).where("lines > 0")
