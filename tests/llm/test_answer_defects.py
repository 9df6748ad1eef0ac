from pyspark.sql import functions as F

from quillspark.llm import answer_defects as ad

SCHEMA = "record_kind string, record_id string, question string, answer string, defect string, plain string"
GOOD = [f"镜下见{a}细胞，核仁{b}。" for a in ("鳞状", "腺样", "梭形", "嗜酸", "浆样", "杯状") for b in ("清晰", "模糊", "消失", "皱缩", "深染")]


def kinds(spark, *pairs):
    rows = [("question", f"g{k}", "核仁有哪些表现？", a, "x", "y") for k, a in enumerate(GOOD)]
    rows += [("response", f"r{k}", q, a, "x", "y") for k, (q, a) in enumerate(pairs)]
    got = [tuple(r) for r in ad.defects(spark.createDataFrame(rows + rows[-1:], SCHEMA)).collect()]
    assert len(got) == len({r[:2] for r in got})
    assert not [r for r in got if r[0] == "question"]
    by = {r[1]: r[2] for r in got}
    return [by.get(f"r{k}") for k in range(len(pairs))]


def test_empty(spark):
    q = "核仁有哪些表现？"
    assert kinds(spark, *[(q, a) for a in (None, "", " 　\n", "N/A", "**答案**：", "<answer></answer>", "[]", "null", "待补充", "……", "-")]) == ["empty"] * 11
    assert kinds(spark, (None, None), (None, GOOD[0])) == ["empty", None]


def test_copy_and_refusal(spark):
    q = "为什么血液稀释会造成胞质边缘拉长？"
    assert kinds(spark, (q, q), (q, "您问的是：" + q), (q, q[:-1]), (q, q + q), (q, "为何血液稀释会造成胞质边缘拉长。"), (q, "关于" + q[:-1] + "这一问题，" + GOOD[0])) == ["copy"] * 5 + [None]
    e = "Why can delayed fixation make nuclear membranes look glassy?"
    assert kinds(spark, (q, "抱歉，我不能回答这个问题，建议前往医院就诊。"), (e, "I'm sorry, but I cannot help with this request."), (q, "我不能代替医师作出诊断，不过就形态而言，" + GOOD[1]), (e, "Unfortunately, no response can be provided here. Try another question.")) == ["refusal", "refusal", None, "refusal"]


def test_other_language(spark):
    zh, en = "核仁有哪些表现？请说明。", "Describe the nucleoli of the cells after brushing."
    french = "Le compte rendu indique des cellules dans le lobe avec une membrane."
    assert kinds(spark, (zh, "The nucleoli are coarse and the chromatin is pale."), (en, GOOD[0]), (zh, "请把“核仁深染”译成英文。"), ("请把“核仁深染”译成英文。", "Hyperchromatic nucleoli."), (zh, "CK7"), (zh, "淋巴瘤（lymphoma），pale nucleoli 为主要依据，" + GOOD[0]), (en, french)) == ["other_language", "other_language", None, None, None, None, "other_language"]


def test_truncated(spark):
    q = "核仁有哪些表现？请说明。"
    answers = ["镜下见鳞状细胞，", "镜下见鳞状细胞，（核", "镜下见鳞状细胞，核……", "镜下见鳞状细胞，核仁深", "镜下见鳞状细胞，核仁深染", "类癌", "①核仁清晰；②", "“核仁清晰。"]
    assert kinds(spark, *[(q, a) for a in answers]) == ["truncated", "truncated", "truncated", "truncated", None, None, "truncated", "truncated"]


def test_units_that_their_successor_continues(spark):
    names = ["abc def", "abc def ghi", "abc def gxi", "abd", "zz", "zzz", "q"]
    units = spark.createDataFrame([(n,) for n in names], "unit string")
    assert {r[0] for r in ad.continued(units).collect()} == {"abc def", "zz"}
    assert ad.continued(units.limit(0)).count() == 0


def test_neighbours_across_partitions(spark):
    # many more partitions than rows: each unit alone in one, with empty ones between
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        names = ["a" * k for k in range(1, 12)] + ["b" * k for k in range(1, 12)] + ["c"]
        units = spark.createDataFrame([(n,) for n in names], "unit string")
        assert {r[0] for r in ad.continued(units).collect()} == set(names) - {"a" * 11, "b" * 11, "c"}
    finally:
        spark.conf.unset("spark.sql.shuffle.partitions")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_neighbours_decide_without_statistics(spark):
    answers = ["镜下见鳞状细胞，核膜着橙黄色、质", "镜下见腺样细胞，核膜着橙黄色、质地细腻。"]
    rows = spark.createDataFrame([("response", str(k), "核仁有哪些表现？", a, "x", "y") for k, a in enumerate(answers)], SCHEMA)
    judged, truncated = ad.analyse(rows)
    assert [(r["answer"], "neighbour" in r["rules"]) for r in judged.join(truncated, F.xxhash64("answer") == F.col("answer_id")).collect()] == [(answers[0], True)]


def test_terms_need_no_sentence(spark):
    rows = spark.createDataFrame([(t,) for t in ("类癌", "CK7", "转移性大细胞神经内分泌癌伴", "核膜着橙", "the nuclei of", "carcinoid tumour, typical")], "text string")
    assert [r[0] for r in rows.where(ad.is_term(F.col("text"))).collect()] == ["类癌", "CK7", "转移性大细胞神经内分泌癌伴"]


def test_length_spikes(spark):
    rows = [("x" * 50,)] * 40 + [("y" * n,) for n in range(40, 61)]
    assert [r[0] for r in ad.length_spikes(spark.createDataFrame(rows, "text string")).collect()] == [50]


def test_no_pairs_and_long_answers(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ad.defects(empty).count() == 0
    long = spark.createDataFrame([("response", "r", "核仁有哪些表现？请说明。", "核仁清晰，细胞增大。" * 20_000, "x", "y")], SCHEMA)
    assert ad.defects(long).count() == 0
