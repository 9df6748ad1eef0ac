import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import page_spam as ps

SCHEMA = "doc_id long, text string, missing double, masked string"
PROSE = "镜下见梭形细胞与浆样细胞相邻，核仁清晰而胞质淡染。术后第3天复查左上叶，细胞的核膜增大。"


def brute(text, least, times):
    covered = [False] * len(text)
    for i in range(len(text) - least + 1):
        gram = text[i : i + least]
        if sum(text.startswith(gram, j) for j in range(len(text))) >= times:
            covered[i : i + least] = [True] * least
    return sum(covered) / len(text) if text else 0.0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abc", max_size=60), st.integers(1, 5), st.integers(2, 4))
def test_coverage_equals_brute_force(text, least, times):
    expected = pytest.approx(brute(text, least, times))
    assert ps.repeated_shares(text, (least,), times)[0] == expected
    assert ps.counted_shares(["ab", text, "", "c"], [2, least, 3, 1], times)[1] == expected


def test_long_pages_have_the_coverage_of_their_whole_text(spark, monkeypatch):
    rng = random.Random(2)
    block = "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(700))
    texts = [block * 3, block * 2, block * 2 + block[::-1] + block]
    rows = spark.createDataFrame([(k, t, 0.0, "x") for k, t in enumerate(texts)], SCHEMA)
    whole_rows = sorted(ps.spam_scores(rows).collect())
    whole = [tuple(r) for r in whole_rows]
    monkeypatch.setattr(ps, "AUTOMATON_CHARS", 500)
    assert sorted(map(tuple, ps.spam_scores(rows).collect())) == whole
    assert [round(r["phrase_coverage"], 2) for r in whole_rows] == [1.0, 0.0, 0.75]


def test_settled_pages_are_those_below_the_score(spark):
    rows = spark.createDataFrame([(k, t, 0.0, "x") for k, t in enumerate(SPAM + FINE)], SCHEMA)
    every = ps.spam_scores(rows)
    assert sorted(map(tuple, ps.spam_scores(rows, 0.5).collect())) == sorted(map(tuple, every.where("score > 0.5").collect()))


SPAM = [
    "\n".join(f"https://a.example/p/{k}" for k in range(30)),
    "、".join(f"{c}{d}{x}" for c in ("云屏", "松汀") for d in ("腺癌", "类癌") for x in ("多少钱", "哪家好", "在线咨询", "专家预约")),
    "。".join(f"{d}{x}" for d in ("腺癌", "类癌", "刷检") for x in ("多少钱", "哪家好", "最新报价", "专家预约")),
    "#巴氏法 #CK7 #腺癌 #瑞氏法 #CK20 #类癌",
    "#肺泡灌洗#小细胞·癌#快速染色#TTF-1#巴氏法#肉芽肿性炎#ALK#错构瘤",
    "\n".join(f"品牌:禾片 型号:K{k} 规格:{k}片/盒 现货 包邮" for k in range(12)),
    "Brushing is brushing, and brushing for lavage means brushing lavage. " * 12,
    PROSE + "\n" + "".join(f'<a href="http://x.test/{k}">类癌批发</a>' for k in range(20)),
]
KINDS = list(zip("梭形 浆样 杯状 嗜酸 裸核 泡沫样 鳞状样 合体样".split(), "核膜 胞界 核仁 染色质 胞质 核沟 胞膜 细胞核".split(), strict=True))
LONG = PROSE + "经刷检取得的组织印片胞质居中，稀释后再涂后细胞约占3%。采用巴氏法时核沟着灰绿色，染液陈旧会使其模糊。究竟是类癌还是腺癌？背景为少量黏液及结晶，未见杯状细胞。"
FINE = [
    LONG,
    "目录\n" + "\n".join(f"第{k}节 {a}细胞的{b} ..... {k}" for k, (a, b) in enumerate(KINDS)),
    "玻片号 | 主要细胞 | 占比 | 标记\n" + "\n".join(f"{k} | {a}细胞 | {k}% | {b}" for k, (a, b) in enumerate(KINDS)),
    PROSE + "\n参考文献\n" + "\n".join(f"[{k}] 佚名. {a}{b}标本{k}例分析. 虚拟胸科学报, 20{k + 10}, 3(2): 1-{k}." for k, (a, b) in enumerate(KINDS)),
    "术语表\n" + "\n".join(f"{b}：{a}细胞约占{k}%，多见于类癌。" for k, (a, b) in enumerate(KINDS)),
    LONG + "\n关键词：类癌；腺癌\nhttps://a.example/p/1",
    "The reviewer noted that spindle cells show pale nuclei and advised to keep a slide. In lavage from the carina, granules appear coarse.",
]


def test_spam_and_its_look_alikes(spark):
    rows = [(k, t, 0.0, "x") for k, t in enumerate(SPAM + FINE)]
    got = {r["doc_id"]: r["score"] for r in ps.spam_scores(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {k for k, s in got.items() if s > 0.5} == set(range(len(SPAM)))


def test_odd_rows(spark):
    rows = [(1, None, 0.0, "x"), (2, "", 0.0, "x"), (3, " \n　", 0.0, "x"), (4, "类癌批发 " * 60_000, 0.0, "x"), (4, "类癌批发 " * 60_000, 0.0, "x")]
    got = [(r["doc_id"], r["score"] > 0.5) for r in ps.spam_scores(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert set(got) == {(4, True)}
    assert ps.spam_scores(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [r[0] for r in ps.spam_scores(spark.createDataFrame(rows, SCHEMA), 0.5).collect()] == [4, 4]
