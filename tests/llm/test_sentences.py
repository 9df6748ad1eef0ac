import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import sentences as se

LEXICON = se.Lexicon({"会诊": (200, 1), "会": (200, 1), "但": (0, 40), "等": (0, 30), "术后": (50, 0)}, {"列": (90, 30)}, frozenset())


def cut(text):
    return [text[a:b] for a, b in se.units(text, LEXICON)]


@pytest.mark.parametrize(
    "text, units",
    [
        ("胞质淡染。核仁清晰？！为何？", ["胞质淡染。", "核仁清晰？！", "为何？"]),
        ("呈条索状排列.右下叶 v2.7.4 测得 p=0.023，清晰。", ["呈条索状排列.", "右下叶 v2.7.4 测得 p=0.023，清晰。"]),
        ("会诊组指出：“核仁清晰。细胞增大！”术后复查。", ["会诊组指出：“核仁清晰。细胞增大！”", "术后复查。"]),
        ("“核仁清晰。”会诊组在第3次记录中写道。术后复查。", ["“核仁清晰。”会诊组在第3次记录中写道。", "术后复查。"]),
        ("报告称“类癌？待查。”但核仁清晰。", ["报告称“类癌？待查。”但核仁清晰。"]),
        ("片状、条索状……等排列均可出现。标本（是否为伪影？），仍可。", ["片状、条索状……等排列均可出现。", "标本（是否为伪影？），仍可。"]),
        ("①甲；②乙；③丙。丁。", ["①甲；②乙；③丙。", "丁。"]),
        ("Dr. Q. Marl read approx. 98 slides vs. 211 before. See Fig. 3.15 and Table 4, i.e. the area. Cells...  but none.", ["Dr. Q. Marl read approx. 98 slides vs. 211 before.", "See Fig. 3.15 and Table 4, i.e. the area.", "Cells...  but none."]),
        ('"Cells form rows. Please review," wrote the reader. The note reads: "One. Two." HMB45 was low.', ['"Cells form rows. Please review," wrote the reader.', 'The note reads: "One. Two."', "HMB45 was low."]),
        ("Cells (artifact? see slide 5) were pale. pH was 7.2. p40 rose! It ended at 4:51 a.m. on site.", ["Cells (artifact? see slide 5) were pale.", "pH was 7.2.", "p40 rose!", "It ended at 4:51 a.m. on site."]),
        ("Am 13. Tag fanden sich Zellen, vgl. Abb. 15. Der Befund: „Eins. Zwei.“ Bei 64 von 78. Dann z. B. ca. 3.", ["Am 13. Tag fanden sich Zellen, vgl. Abb. 15.", "Der Befund: „Eins. Zwei.“", "Bei 64 von 78.", "Dann z. B. ca. 3."]),
        ("Le Dr. Ormel, p. ex. au champ n° 4, cf. fig. 23. Faut-il ? Le texte : « Un. Deux. » Fin (env. 9 %).", ["Le Dr. Ormel, p. ex. au champ n° 4, cf. fig. 23.", "Faut-il ?", "Le texte : « Un. Deux. »", "Fin (env. 9 %)."]),
        ("担当者は「核膜が偏在。再検が望ましい。」と第7票に記した。次。", ["担当者は「核膜が偏在。再検が望ましい。」と第7票に記した。", "次。"]),
        ("क्या यह है? डॉ. वेरम ने लिखा: “एक। दो।” तीन।", ["क्या यह है?", "डॉ. वेरम ने लिखा: “एक। दो।”", "तीन।"]),
        ("ผู้อ่านแผ่นที่ 75 เห็นว่าต่าง ๆ กัน ตัวอย่างพบ 15 % และเรียบ ควรย้อม WT1 เพิ่ม", ["ผู้อ่านแผ่นที่ 75 เห็นว่าต่าง ๆ กัน", "ตัวอย่างพบ 15 % และเรียบ", "ควรย้อม WT1 เพิ่ม"]),
        ("## 第三节 核膜\n正文一句\n又一句。\n1) 甲\n- 乙\n\n尾", ["## 第三节 核膜", "正文一句\n又一句。", "1) 甲", "- 乙", "尾"]),
        ("Cells (see slide\n87) were pale. Next one.", ["Cells (see slide\n87) were pale.", "Next one."]),
        ("ACGT" * 60 + "\n核仁清晰。", ["ACGT" * 60, "核仁清晰。"]),
        ("未闭合“引号。下一句。", ["未闭合“引号。", "下一句。"]),
        ("Check ALK.In lavage it rose.Next CK7.Agreement was low.", ["Check ALK.", "In lavage it rose.", "Next CK7.", "Agreement was low."]),
        ("质地疏松.p40阳性率为3%。", ["质地疏松.", "p40阳性率为3%。"]),
        ("核轮廓光整.lymphoma一词指细胞。约占4%.carcinoid一词指细胞。", ["核轮廓光整.", "lymphoma一词指细胞。", "约占4%.", "carcinoid一词指细胞。"]),
        ("", []),
        (" \n\t ", []),
    ],
)
def test_units(text, units):
    assert cut(text) == units


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aZ9 .。!?“”「」()\n#-1)ก๑", max_size=200))
def test_units_cover_everything_but_space(text):
    spans = se.units(text, LEXICON)
    assert all(a < b and not text[a].isspace() and not text[b - 1].isspace() for a, b in spans)
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
    assert "".join("".join(text[a:b].split()) for a, b in spans) == "".join(text.split())


def test_lattice_takes_the_likelier_word():
    lexicon = se.Lexicon({"但": (0, 10), "但是": (0, 500), "是": (40, 1)}, {}, frozenset())
    assert lexicon.first_word("但是清晰") == "但是"
    assert se.Lexicon({}, {}, frozenset()).is_gap("甲", "乙") is False


def test_table_results(spark):
    schema = "doc_id string, content string, start_char int, key string"
    rows = [("a", "甲。乙。", 5, "k"), ("a", "甲。乙。", 5, "k"), ("n", None, 1, "k"), ("e", "", 1, "k"), ("l", "一句话。" * 30_000, 1, "k")]
    got = [tuple(r) for r in se.sentence_units(spark.createDataFrame(rows, schema)).collect()]
    assert [r for r in got if r[0] == "a"] == [("a", 0, 2), ("a", 2, 4)]
    assert len([r for r in got if r[0] == "l"]) == 30_000
    assert {r[0] for r in got} == {"a", "l"}
    assert se.sentence_units(spark.createDataFrame([], schema)).count() == 0


def test_abbreviations_are_learned(spark):
    df = spark.createDataFrame([("a", "The abc. next one was xyz. " * 60)], "doc_id string, content string")
    assert "abc" in {r["key"] for r in se.learned_abbreviations(se.gap_counts(df)).collect()}
    got = se.sentence_units(df.union(spark.createDataFrame([("b", "An abc. 4 is new. Last.")], df.schema))).where("doc_id = 'b'").collect()
    assert [(r["start_char"], r["end_char"]) for r in got] == [(0, 17), (18, 23)]


def test_gaps_are_decided_like_by_the_whole_dictionary(spark):
    """The distributed look-up gives what one dictionary in memory gives."""
    texts = ["核仁清晰，但淡染。会诊时复查。片状……会诊等均可。“核仁清晰。”会诊后，“待查。”但可。" * 3, "甲……乙，但是。会诊。丙……但淡染，等。", "会诊。会诊，会诊。但，但。" * 9, "片状……等，会诊组……会诊。"]
    df = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "doc_id string, content string")
    rows = se.gap_counts(df).where(F.col("at_end") + F.col("inside") >= se.MIN_COUNT).collect()
    pick = {side: {r["word"]: (r["at_end"], r["inside"]) for r in rows if r["side"] == side} for side in ("open", "final")}
    lexicon = se.Lexicon(pick["open"], pick["final"], frozenset())
    want = {(str(k), a, b) for k, t in enumerate(texts) for a, b in se.units(t, lexicon)}
    assert {tuple(r) for r in se.sentence_units(df).collect()} == want
    assert any(lexicon.is_gap(a, b) for a, b in (("状", "会诊等均可"), ("组", "会诊。")))
