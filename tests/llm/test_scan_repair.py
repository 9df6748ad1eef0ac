from pyspark.sql import functions as F

from quillspark.llm import scan_repair

SCHEMA = "doc_id string, content string, page_number int, chapter_title string, section_title string, collection string, s string, line_no int"
REFERENCE = "Forceps sampling shows carcinoma cells. The sampling of signet-ring cells and small-cell carcinoma was negative. 镜下见鳞状样细胞与梭形细胞，细胞核质清晰，支持机化性肺炎。胸水离心标本。"


def rows(*scans):
    out = [(f"ref{k}", REFERENCE + f" 第{k}例。", None, None, None, "atlas_text", "x", 9) for k in range(6)]
    return out + [(d, text, page, chapter, section, "atlas_scan", "x", 9) for d, text, page, chapter, section in scans]


def contents(spark, *books):
    return spark.createDataFrame([(b, None, None) for b in books], "book_title string, chapter_title string, section_title string")


def found(spark, data, books=("气道细胞图解",)):
    return {tuple(r) for r in scan_repair.noise(spark.createDataFrame(data, SCHEMA), contents(spark, *books)).collect()}


def test_each_kind_of_noise(spark):
    text = "# 第一章 鳞癌\nForceps sam-\n12\npling of signet-\nring cells.\n第一章 鳞癌 · 12\r\n镜下见梭形细胸与细胞。\n分项计数：\n340\n12\nThe sarnpling was neg□tive.\n气道细胞图|"
    got = found(spark, rows(("d", text, 12, "第一章 鳞癌", None)))
    assert got == {("d", 2, "hyphen_break"), ("d", 3, "page_number"), ("d", 6, "running_header"), ("d", 6, "page_number"), ("d", 7, "misread"), ("d", 10, "page_number"), ("d", 11, "misread"), ("d", 12, "running_header")}


def test_misread_part_of_a_cut_word_is_on_its_own_line(spark):
    got = found(spark, rows(("d", "carci-\nnorna cells\nsarn-\npling", None, None, None)))
    assert got == {("d", 1, "hyphen_break"), ("d", 2, "misread"), ("d", 3, "hyphen_break"), ("d", 3, "misread")}


def test_real_han_words_are_kept(spark):
    assert found(spark, rows(("d", "胸水离心标本。", 3, "", ""))) == set()


def test_defined_results_of_odd_rows(spark):
    data = rows(("n", None, 1, "t", "t"), ("e", "", None, None, None), ("b", "\n\n", 1, None, None))
    assert found(spark, data) == set()
    twice = rows(("d", "sam-\npling", None, None, None), ("d", "sam-\npling", None, None, None))
    assert found(spark, twice) == {("d", 1, "hyphen_break")}
    assert found(spark, [], ()) == set()
    assert found(spark, rows(("l", "镜下见梭形细胸。" * 4000, 5, None, None))) == {("l", 1, "misread")}


def test_paragraphs_are_continuous(spark):
    text = "　　镜下见梭形细胸\n第一章 鳞癌\n12\n与细胞。\n\nForceps sam-\npling shows\ncarcin0ma cells."
    df = spark.createDataFrame(rows(("d", text, 12, "第一章 鳞癌", None)), SCHEMA)
    got = [r["text"] for r in scan_repair.repaired_paragraphs(df, contents(spark)).orderBy("paragraph_no").collect()]
    assert got == ["镜下见梭形细胞与细胞。", "Forceps sampling shows carcinoma cells."]


def test_headers_of_no_title_recur_with_masked_digits(spark):
    scans = [(f"h{k}", f"染色质{'甲乙丙丁戊'[k]}呈网状而\nAnnals of Lung Smears {2001 + k}\n{40 + k}\n核仁{'子丑寅卯辰'[k]}深染。", 40 + k, None, None) for k in range(5)]
    once = [("o", "染色质呈网状而\nAtlas of Lung Smears\n40\n核仁深染。", 40, None, None)]
    got = {r for r in found(spark, rows(*scans, *once)) if r[2] == "running_header"}
    assert got == {(f"h{k}", 2, "running_header") for k in range(5)}
    # the copies of one document do not make a header
    copies = [(f"c{k}", "染色质呈网状而\nAnnals of Lung Smears\n40\n核仁深染。", 40, None, None) for k in range(5)]
    assert not {r for r in found(spark, rows(*copies)) if r[2] == "running_header"}


def test_titles_meet_lines_with_one_damage_or_a_cut_end(spark):
    title = "第三章 淋巴瘤与过敏性肺炎"
    lines = ["第三章 淋巴瘤与过敏性肺炎", "第三章 淋巴口与过敏性肺炎", "口三章 淋巴瘤与过敏性肺炎", "第三章 淋巴瘤与过敏性肺", "第三章 淋巴瘤与过敏性肺炎炎", "第三章 淋巴瘤与…", "第三章 口巴口与过敏性肺炎", "第三章 腺癌与过敏性肺炎图"]
    forms = spark.createDataFrame([(t,) for t in lines], "t string").select("t", scan_repair.masked(F.col("t")).alias("form"))
    titles = scan_repair.title_forms(spark.createDataFrame([], SCHEMA), contents(spark, title))
    hit = scan_repair.header_lines(forms.select("form").distinct(), titles)
    assert {r["t"] for r in forms.join(hit, "form", "left_semi").collect()} == set(lines[:6])


def test_known_words_are_judged_by_their_neighbours(spark):
    reference = [(f"n{k}", "The lesion in lung tissue was 47 m wide. Cells in lung tissue show a clear rim and dear friends met.", None, None, None, "atlas_text", "x", 9) for k in range(6)]
    got = found(spark, reference + [("d", "Lesion m lung tissue, 47 m wide, show a dear rim.", None, None, None, "atlas_scan", "x", 9)])
    assert got == {("d", 1, "misread")}
    df = spark.createDataFrame(reference + [("d", "Lesion m lung tissue, 47 m wide, show a dear rim.", None, None, None, "atlas_scan", "x", 9)], SCHEMA)
    wrong = {(r["wrong"], r["right"]) for r in scan_repair.analyse(df, contents(spark))[2].collect()}
    assert wrong == {("m", "in"), ("dear", "clear")}


def test_glyphs_that_fall_apart(spark):
    assert found(spark, rows(("d", "支持机化性月市炎。", 3, "", ""))) == {("d", 1, "misread")}
    df = spark.createDataFrame(rows(("d", "支持机化性月\n市炎。", 3, "", ""), ("e", "支持机化性\n月市炎。", 3, "", "")), SCHEMA)
    got = {r["doc_id"]: r["text"] for r in scan_repair.repaired_paragraphs(df, contents(spark)).collect()}
    assert got["e"] == "支持机化性肺炎。"


def test_titles_are_taken_without_the_contents(spark, monkeypatch):
    plans, whole = [], scan_repair.title_forms

    def forms(records, toc):
        out = whole(records, toc)
        plans.append(out._jdf.queryExecution().optimizedPlan().toString())
        return out

    monkeypatch.setattr(scan_repair, "title_forms", forms)
    assert ("d", 1, "running_header") in found(spark, rows(("d", "第一章 鳞癌\n正文。", 12, "第一章 鳞癌", None)))
    assert plans and not any("content#" in line for line in plans[0].splitlines() if "Aggregate" in line)
