"""Term groups of the ranking rules. Results depend on exactly these words; pass other groups for other domains."""

ROSE = ["rose", "快速现场评价", "rapid on-site evaluation", "细胞学", "细胞诊断"]
DIAGNOSTIC = ["诊断标准", "诊断要点", "鉴别诊断", "诊断依据", "确诊"]
TREATMENT = ["治疗方案", "治疗方法", "治疗原则", "用药", "手术", "化疗", "放疗"]
CASE = ["病例报告", "病例分析", "个案", "临床病例", "典型病例"]
BASIC_CONCEPTS = ["肺部恶性肿瘤", "肺癌", "肿瘤", "癌症", "细胞学", "病理学", "诊断", "治疗", "症状", "预后", "分期", "分级"]
ROSE_BASIC = ["rose技术", "快速现场评价", "细胞学诊断", "细胞采集", "制片技术", "染色方法", "显微镜检查"]
SUBTYPES = ["腺癌", "鳞癌", "小细胞癌", "大细胞癌", "神经内分泌癌", "细支气管肺泡癌", "肺类癌", "肺肉瘤样癌", "胸膜肺母细胞瘤"]
ROSE_SPECIFIC = ["细胞核增大", "核仁明显", "核分裂象", "细胞异型性", "核浆比失调", "染色质分布不均", "细胞排列紊乱", "印戒细胞", "砂粒体", "坏死碎片"]
TITLE_WORDS = ["rose", "肺部恶性肿瘤", "细胞学", "病理", "诊断", "治疗", "腺癌", "鳞癌", "细胞核", "核仁", "异型性"]
TITLE_TERMS = ["癌", "细胞", "病理", "诊断", "治疗", "rose", "黏液", "腺癌", "鳞癌"]
DESCRIPTIVE = ["呈", "可见", "表现为", "特征为", "特点是", "具有", "显示", "出现", "细胞", "组织", "结构", "形态", "大小", "形状", "颜色", "质地"]
MEDICAL = ["病理", "诊断", "治疗", "预后", "细胞学", "组织学", "影像学", "分化", "恶性", "良性", "肿瘤", "癌症", "病变"]
FIGURE = ["图", "表", "figure", "table", "示意图"]
DESCRIPTIVE_TITLES = ["诊断", "特征", "表现", "形态"]
BASIC_TERMS = ["细胞", "组织", "器官", "病理", "生理", "诊断", "治疗", "预后", "症状", "体征", "检查", "化验", "影像", "手术", "药物"]
PROFESSIONAL_TERMS = ["细胞核", "细胞质", "分化", "恶性", "良性", "肿瘤", "癌症", "转移", "浸润", "预后", "分期", "分级", "病理诊断"]
SEARCH_ENTITIES = ["腺癌", "鳞癌", "小细胞癌", "大细胞癌", "肺腺癌", "肺鳞癌", "黏液腺癌", "粘液腺癌", "印戒细胞癌", "神经内分泌癌", "类癌", "肉瘤样癌", "腺样囊性癌", "黏液表皮样癌", "rose", "细胞学", "病理", "图像特征", "诊断"]
KEY_ENTITIES = ["腺癌", "鳞癌", "小细胞癌", "大细胞癌", "肺腺癌", "肺鳞癌", "黏液腺癌", "粘液腺癌", "印戒细胞癌", "神经内分泌癌", "类癌", "肉瘤样癌", "腺样囊性癌", "黏液表皮样癌", "ROSE", "细胞学", "病理"]
QUESTION_ENTITIES = ["腺癌", "鳞癌", "小细胞癌", "大细胞癌", "肺腺癌", "肺鳞癌", "肺小细胞癌", "肺大细胞癌", "粘液腺癌", "黏液腺癌", "印戒细胞癌", "粘液癌", "乳腺癌", "胃癌", "肝癌", "食道癌", "结肠癌", "直肠癌", "胰腺癌", "胆管癌", "胆囊癌", "甲状腺癌", "前列腺癌", "图像特征", "影像学", "病理学", "细胞学", "组织学", "分化程度", "恶性程度", "转移", "浸润", "预后"]
STOP_PHRASES = ["是什么", "什么是", "的", "吗", "呢", "怎么", "如何", "有哪些", "有什么", "是什么", "什么是", "哪些", "吗", "呢", "啊", "吧", "呀"]
KEYWORD_STOPS = ["什么", "有哪些", "怎么", "如何", "需要", "以及", "和", "的"]
SYNONYMS = {"腺癌": ["腺癌", "腺样囊性癌", "腺泡细胞癌", "腺管状腺癌", "乳头状腺癌"], "图像": ["图像", "镜下", "形态", "外观", "结构", "染色", "图示"], "特征": ["特征", "特点", "表现", "形态", "结构", "性质"]}
QUALITY_TERMS = ["癌细胞", "分化", "核", "质", "染色", "形态", "结构"]
IMAGE_MARKS = ["图", "镜下", "400×", "染色", "外观", "形态"]
IMAGE_WORDS = ["图像", "镜下", "图示", "图", "400×", "染色"]
FEATURE_WORDS = ["特征", "形态", "外观", "结构", "性质", "表现"]
MORPHOLOGY = ["圆形", "立方形", "空泡", "印戒样", "颗粒状", "清楚"]
QUALITY_INDICATORS = ["细胞", "组织", "病理", "诊断", "呈", "可见", "显示"]
QUERY_MEDICAL = ["癌", "细胞", "病理", "诊断", "治疗", "预后", "rose"]
COMPARISON = ["区别", "差异", "不同", "比较", "vs"]
COMPARISON_WIDE = ["区别", "差异", "不同", "比较", "vs", "versus", "对比"]
PRECISE_TERMS = ["ROSE", "N/C", "核质比", "m/N", "核仁长径", "腺泡状", "乳头状", "桑甚状", "异倍体", "多倍体", "肉瘤样癌", "腺泡细胞癌", "小细胞癌", "透明细胞癌"]
SUGGESTIONS = ["肺部恶性肿瘤", "ROSE细胞学", "腺癌特征", "细胞核增大", "快速现场评价", "细胞学诊断", "病理分析", "癌症分期"]
CHAPTER_PHRASES = ["ROSE", "细胞学特点", "细胞组学分型", "恶性肿瘤", "肺部实体", "罕见病", "快速现场评价"]
ALIKE = {"similar": ["相同", "相似", "一样"], "different": ["不同", "区别", "差异"], "advantage": ["优势", "优点", "好处"], "drawback": ["劣势", "缺点", "不足"]}
CELL_FEATURES = ["深染", "浓染", "淡染", "透明", "嗜酸", "嗜碱", "多形性", "异型性", "核大", "核小", "核仁", "核膜", "核质比", "镶嵌", "乳头状", "腺泡状", "桑葚状", "梭形", "圆形", "卵圆形", "立方状", "多边形", "巨细胞", "坏死", "凋亡", "有丝分裂", "核分裂", "细胞质", "细胞膜"]
CANCER_TYPES = ["腺癌", "鳞癌", "小细胞癌", "大细胞癌", "肺腺癌", "肺鳞癌", "乳腺癌", "胃癌", "肝癌", "食道癌"]
MEDICAL_WORDS = ["ROSE", "细胞核", "细胞质", "分化", "恶性", "良性", "肿瘤", "癌症", "病理", "诊断"]
ANATOMY = ["肺部", "肺脏", "支气管", "肺泡", "胸膜", "纵隔", "淋巴结", "上皮", "腺体"]
KEY_CONCEPTS = ["细胞", "组织", "器官", "病理", "生理", "诊断", "治疗", "预后"]
