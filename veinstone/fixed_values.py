"""Fixed values.

Every constant below has to equal the published behaviour for results to be
right: patterns, word lists, weights and thresholds.  They are data, kept in
one place and in natural order; the logic that uses them lives elsewhere.
"""

# --- fixed values: character classes -------------------------------------
CJK = "㐀-鿿"
CJK_WITH_COMPAT = "㐀-鿿豈-﫿"
# every character for which str.isspace() holds
SPACE = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
              *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)

# --- fixed values: document-side patterns --------------------------------
IDENTIFIER = r"(?<![A-Za-z0-9])([A-Za-z][A-Za-z0-9]{1,12}-\d{2,}(?:-[A-Za-z0-9]+)*)"
ACRONYM = r"(?<![A-Za-z0-9])([A-Za-z]{2,12}\d{2,})(?![A-Za-z0-9])"
ASCII_TOKEN = r"[a-z0-9][a-z0-9_.:/-]*"
FEATURE_TOKEN = r"[a-z0-9][a-z0-9_-]*"
ESTIMATE_WORD = r"[A-Za-z0-9_./:+#-]+"
SENTENCE_END = "。！？.!?；;"
CONTROLLED_ALIAS = (
    r"(?im)^(?:Chinese business name\s*/\s*中文业务称谓|"
    r"English operational name\s*/\s*英文运行称谓)\s*:\s*([^\r\n]+?)\s*$"
)
ELLIPSIS = r"\.{3,}|…+"
QUOTED_NUMBER = r"(?<![A-Za-z0-9])\d+(?:[,.]\d+)*"
QUOTED_NAME = r"\b[A-Z][A-Za-z0-9-]{2,}(?:[ \t]+[A-Z][A-Za-z0-9-]{2,})+"
WRAPPED_IDENTIFIER = r"((?<!\w)[A-Za-z][A-Za-z0-9-]*-[A-Za-z0-9-]+)\n(?=[A-Za-z0-9-])"

# --- fixed values: question-side patterns --------------------------------
ZH_ENTITY = r"([㐀-鿿]{2,20})(?:业务|系统|项目|模块)"
ZH_LEADING_SUBJECT = (
    r"^([㐀-鿿]{2,20}?)\s*(?:当前|的|在|受|使用|由|如果|若|最新|发生|执行|需要)"
)
ZH_BRIDGE_SUBJECT = r"^([㐀-鿿]{2,20}?)\s*(?:当前|的|在|受|使用|由|如果|若|最新)"
EN_ENTITY = (
    r"\b(?i:for|about)\s+([A-Z][A-Za-z0-9-]*(?:\s+[A-Z][A-Za-z0-9-]*){0,4})"
    r"(?=\s*[,\.?（(]|\s*$)"
)
EN_RELATED = (
    r"\b(?i:knowledge|information|documents?|details?|content)\s+"
    r"(?:(?i:is)\s+)?(?i:related|relevant)\s+(?i:to)\s+"
    r"([A-Z][A-Za-z0-9-]*(?:\s+[A-Z][A-Za-z0-9-]*){0,4})(?=\s*[,\.?]|\s*$)"
)
ZH_SPAN = r"([㐀-鿿A-Za-z0-9][㐀-鿿A-Za-z0-9·_.\-/ ]{1,39}?)"
ZH_QUOTED = r"[\"“”「」『』]" + ZH_SPAN + r"[\"“”「」『』]"
ZH_STRUCTURED = (
    ("related", r"^(?:与|和|跟|关于|有关|有关于|针对|围绕)\s*" + ZH_SPAN
     + r"\s*(?:相关|有关|关联|方面)(?:的)?"),
    ("about", r"^(?:关于|有关|有关于|对于|针对|围绕)\s*" + ZH_SPAN
     + r"(?=\s*(?:，|,|的|都有哪些|有哪些|是什么|$))"),
    ("topic_first", r"^" + ZH_SPAN
     + r"\s*[，,]\s*(?:请)?(?:介绍|说明|总结|概括|整理|列出|讲讲|说说)"),
    ("definition", r"^" + ZH_SPAN
     + r"\s*(?:是什么|有哪些|都有哪些|是做什么的|怎么理解|什么意思|"
     r"如何定义|怎么样|有什么作用|如何使用)"),
    ("knowledge", r"^" + ZH_SPAN
     + r"\s*(?:相关|有关|关联|方面)?(?:的)?(?:具体)?"
     r"(?:知识|信息|内容|资料|文档|规则|情况|详情|介绍|说明)"),
)
ZH_DEFINITION_TAIL = (
    r"(?:的)?(?:当前|最新|正式)?(?:中文控制规则|控制规则|治理责任人|业务负责人|审批角色|"
    r"审批阈值|失败队列|接口路径|策略|规则|门槛|阈值|接口|状态|责任人|负责人|超时)$"
)
ZH_BARE_BLOCKERS = (
    "当前", "最新", "发生", "执行", "需要", "使用", "如果", "怎么办", "如何", "为什么",
    "什么", "多少", "哪个", "比较", "区别", "是否", "门槛", "接口", "审批", "超时",
)
ZH_BARE_PHRASE = r"[㐀-鿿A-Za-z0-9·_.\-/ ]+"
ZH_POLITE = (
    r"^(?:请问|请|麻烦(?:你)?|烦请|劳驾|能否|可否|你能(?:否)?|可以(?:请)?|是否可以)\s*",
    r"^(?:(?:你)?帮我|为我|给我|我想(?:要|知道|了解)?(?:一下|下)?|"
    r"想(?:要|知道|了解)?(?:一下|下)?)\s*",
    r"^(?:从)?(?:这个)?知识库(?:里|中)?\s*",
    r"^(?:列出|整理|汇总|查找|查询|查|搜索|介绍|说明|总结|概括|了解|知道|告诉我|"
    r"讲讲|说说|看看)(?:一下|下)?\s*",
)
ZH_PARTICLES = ("吗", "呢", "吧")
BUSINESS_SUFFIXES = ("业务", "系统", "项目", "模块")
QUESTION_TRIM = " \t\r\n，,。.!！?？；;：:"
SUBJECT_TRIM = " \t\r\n，,。.!！?？；;：:\"'“”「」『』"
GENERIC_SUBJECTS = ("业务", "系统", "项目", "模块", "规则", "接口", "文档", "策略")
GENERIC_ENGLISH_WORDS = (
    "business", "operation", "operations", "process", "project", "service", "system",
    "team", "workflow",
)
PLAN_FIELDS = {  # name: most values, longest value
    "subjects": (6, 80), "requested_facts": (8, 80), "constraints": (8, 100),
    "scenario_terms": (8, 100), "retrieval_queries": (4, 220),
}
PLAN_LANGUAGES = ("zh", "en", "mixed", "other")
PLAN_INTENTS = ("lookup", "compare", "summarize", "procedure", "troubleshoot", "unknown")

# --- fixed values: authority terms ---------------------------------------
AUTHORITATIVE_TERMS = (
    "approved", "current", "effective date", "signed", "authoritative",
    "正式", "当前", "生效", "已批准",
)
HISTORICAL_TERMS = (
    "not the approval page", "not current", "not the final decision", "retired",
    "historical", "superseded", "deprecated", "draft", "candidate", "never approved",
    "旧值", "退役", "历史", "草稿", "候选", "作废",
)
HISTORY_QUESTION_TERMS = ("历史", "旧值", "过去", "退役")
HISTORY_QUESTION_WORDS = r"\b(?:historical|old|retired)\b"
BRIDGE_TYPES = (
    "business-requirement", "requirement", "terminology-registry", "mapping",
    "reference-index",
)
COMPLEX_MARKERS = (
    "比较", "对比", "归纳", "综合", "差异", "为什么", "跨系统",
    "compare", "contrast", "summarize across", "difference", "differences",
)

# --- fixed values: weights and limits ------------------------------------
FILENAME_WEIGHT, TITLE_WEIGHT, CONTENT_WEIGHT = 4, 3, 1
RANK_UNIT, RANK_SCALE = 0.1, 20.0
EXACT_TERM_SCORE, SIGNAL_SCORE = 100.0, 8.0
QUERY_TOKEN_LIMIT, SIGNAL_LIMIT = 64, 12  # of a question; texts of chunks are indexed whole
RRF_K, APPROVED_BOOST, SECONDARY_WEIGHT, ANCHOR_BOOST = 60, 1.08, 0.92, 1.35
FALLBACK_BELOW = 3
MAX_ANCHOR_ROWS, MAX_LINKED, MAX_ID_CHANNELS = 8, 12, 10
SHORT_CHUNK, NEIGHBOR_DECAY, USEFUL_LENGTH = 180, 0.99, 100
BUDGET_OVERHEAD, PLUS_BUDGET, MAX_BUDGET = 40, 4000, 7000
MAX_REPAIRED_QUOTE, MIN_ANCHOR_SHARE, LEAST_LETTERS = 800, 0.7, 4
ROWS_PER_TABLE_UNIT = 25
CHUNK_NAMESPACE = "73ac24df-296f-4532-9dc8-e5890e877564"

# --- fixed values: enumerations ------------------------------------------
LIFECYCLES = ("draft", "approved", "deprecated")
ANSWER_STATUSES = ("answered", "insufficient_evidence", "conflict")
FEEDBACK_RATINGS = ("correct", "incorrect", "missing_source", "irrelevant_source")
SUPPORTED_SUFFIXES = (
    ".docx", ".doc", ".xlsx", ".xls", ".xlsm", ".md", ".markdown", ".txt", ".html",
    ".htm", ".pdf", ".csv",
)

# --- fixed values: texts --------------------------------------------------
REFUSALS = {
    ("no_evidence", "zh"): "知识库中没有找到足以支持结论的证据。",
    ("no_evidence", "en"): "The knowledge base does not contain sufficient evidence for a conclusion.",
    ("validation", "zh"): "已找到相关资料，但模型输出未通过引用校验，因此本次不生成结论。",
    ("validation", "en"): "Relevant sources were found, but the model output failed citation validation; no conclusion was returned.",
    ("provider", "zh"): "已找到相关资料，但生成模型当前不可用，因此本次不生成结论。",
    ("provider", "en"): "Relevant sources were found, but the generation model is currently unavailable; no conclusion was returned.",
}
LINKED_PREFIX = "Approved cross-document references: "
PLAN_CONTEXT_LABELS = (
    ("Business subjects", "subjects"),
    ("Exact identifiers", "identifiers"),
    ("Requested facts", "requested_facts"),
    ("Operational scenarios", "scenario_terms"),
    ("Constraints", "constraints"),
)
