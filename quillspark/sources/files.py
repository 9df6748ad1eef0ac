"""Readers and writers of files: marked-up texts, chunks, questions, knowledge, stores and reports.

Readers take a path or glob pattern and stay lazy; malformed questions fail, missing chunk files give no rows. Writers
return nothing and write with Spark, one file a task; summaries collect one row.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK_SCHEMA = "chunk_id string, content string, chapter_title string, section_title string, page_number int, metadata map<string,string>"
QUESTION_SCHEMA = "id string, question string, question_type string, difficulty string, disease_category string, expected_answer string, related_concepts array<string>, source_chapter string, source_section string, expected_chunk_ids array<string>, keywords array<string>, created_at string"
KNOWLEDGE_SCHEMA = "chapters array<struct<number:string,title:string>>, diseases array<struct<name:string,category:string,features:array<string>>>, concepts array<string>, images array<struct<alt:string,url:string>>, features array<string>"


def markdown_texts(spark: SparkSession, path: str) -> DataFrame:
    """``(path, text)``: every file as a whole."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def markdown_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(path, line_no, line)``, numbered from 1; every line keeps its end."""
    lines = F.filter(F.split("text", r"(?<=\n)"), lambda l: l != "")
    return markdown_texts(spark, path).select("path", F.posexplode(lines).alias("pos", "line")).select("path", (F.col("pos") + 1).alias("line_no"), "line")


def chunks_json(spark: SparkSession, path: str, by_line: bool = False) -> DataFrame:
    """Chunks of a file that holds a JSON array, or one object a line as ``write_chunks_json`` leaves them; a missing file gives no rows."""
    try:
        return spark.read.json(path, schema=CHUNK_SCHEMA, multiLine=not by_line)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], CHUNK_SCHEMA)


def questions_json(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a file that holds a JSON array; broken rows and unknown keys fail."""
    known = spark.createDataFrame([], QUESTION_SCHEMA).columns
    found = spark.read.json(path, multiLine=True).columns
    unknown = sorted(set(found) - set(known))
    if unknown:
        raise ValueError(f"unknown keys: {', '.join(unknown)}")
    return spark.read.json(path, schema=QUESTION_SCHEMA, multiLine=True, mode="FAILFAST")


def knowledge_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The parts of a nested knowledge file, one row an entry."""
    whole = spark.read.json(path, schema=KNOWLEDGE_SCHEMA, multiLine=True)
    out = {}
    for part in ("chapters", "diseases", "images"):
        out[part] = whole.select(F.explode(part).alias("x")).select("x.*")
    for part in ("concepts", "features"):
        out[part] = whole.select(F.explode(part).alias(part[:-1]))
    return out


def write_chunks_json(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").json(path)


def upsert(stored: DataFrame, fresh: DataFrame, key: str, order: str) -> DataFrame:
    """``stored`` with the rows of ``fresh``; of rows with the same key the one with the highest ``order`` stays, at a tie a fresh one."""
    both = stored.withColumn("_fresh", F.lit(0)).unionByName(fresh.withColumn("_fresh", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.col(order).desc_nulls_last(), F.col("_fresh").desc())
    return both.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth", "_fresh")


def append_vectors(vectors: DataFrame, path: str, dimensions: int) -> None:
    """Appends vectors to a store; one of another length or a null fails the write."""
    checked = F.when(F.size("embedding") == dimensions, F.col("embedding").cast("array<float>")).otherwise(F.raise_error(F.lit(f"a vector has not {dimensions} dimensions")))
    vectors.select("vec_id", checked.alias("embedding")).write.mode("append").parquet(path)


def rebuild(chunks: DataFrame, vectors: DataFrame, folder: str) -> None:
    """Replaces both stores."""
    chunks.write.mode("overwrite").parquet(f"{folder}/chunks")
    vectors.write.mode("overwrite").parquet(f"{folder}/vectors")


def update_chapters(stored: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Titles of ``found (doc_id, chapter_title, section_title)`` put into ``stored``, and one row of counts.

    Blank titles leave the stored ones as they are; ids that the store lacks count as failed.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    new = found.groupBy("doc_id").agg(F.max("chapter_title").alias("_chapter"), F.max("section_title").alias("_section"))
    merged = stored.join(new, "doc_id", "left")
    for column, fresh in (("chapter_title", "_chapter"), ("section_title", "_section")):
        merged = merged.withColumn(column, F.when(blank(F.col(fresh)), F.col(column)).otherwise(F.col(fresh)))
    updated = ~(blank(F.col("_chapter")) & blank(F.col("_section")))
    out = merged.withColumn("has_chapter_info", F.coalesce(updated, F.lit(False)) | ~blank(F.col("chapter_title")))
    state = new.join(stored.select("doc_id").distinct().withColumn("_stored", F.lit(True)), "doc_id", "left")
    counts = state.agg(F.count("*").alias("processed"), F.count_if(updated & F.col("_stored").isNotNull()).alias("updated"), F.count_if(F.col("_stored").isNull()).alias("failed"))
    return out.drop("_chapter", "_section"), counts


def write_report(summary: DataFrame, details: DataFrame, path: str) -> None:
    """A report as JSON: the summary rows and, beside them, the rows of detail."""
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    details.write.mode("overwrite").json(f"{path}/details")


def markdown_summary(summary: DataFrame, title: str = "Evaluation") -> str:
    """A table of ``(k, recall, precision, f1, hit_rate)`` and whether the mean recall at 5 is over 0.7; one small aggregate is collected."""
    rows = summary.groupBy("k").agg(*[F.avg(c).alias(c) for c in ("recall", "precision", "f1", "hit_rate")]).orderBy("k").limit(100).collect()
    lines = [f"# {title}", "", "| k | recall | precision | F1 | hit rate |", "|---|---|---|---|---|"]
    lines += [f"| {r['k']} | {r['recall']:.3f} | {r['precision']:.3f} | {r['f1']:.3f} | {r['hit_rate']:.3f} |" for r in rows]
    good = any(r["k"] == 5 and r["recall"] > 0.7 for r in rows)
    return "\n".join([*lines, "", "Retrieval is good." if good else "Retrieval needs work."])


def page_lines(lines: DataFrame, group: str) -> DataFrame:
    """``(group, page, doc_id, line_no, line)``: the lines of each group with a heading before those of every page.

    ``lines`` has ``group``, ``page_number``, ``doc_id``, ``line_no`` and ``line``; a missing page counts as page 0. Sorted by all but the
    last column they are the document; no group is gathered in one value or task.
    """
    page = F.coalesce("page_number", F.lit(0))
    heads = lines.select(group, page.alias("page"), F.lit("").alias("doc_id"), F.lit(0).alias("line_no"), F.format_string("#### 第%d页", page).alias("line")).distinct()
    return heads.unionByName(lines.select(group, page.alias("page"), "doc_id", "line_no", "line"))
