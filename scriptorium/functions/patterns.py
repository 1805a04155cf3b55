"""Patterns, word lists and limits that results depend on. All values here are fixed values."""

#: White space as str.strip and \s know it; both regular expression engines in use read this class alike.
WS = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NWS = "[^" + WS[1:]
DIGIT = r"\p{Nd}"
HAN = r"[\x{4e00}-\x{9fff}]"
NUMERAL = r"[一二三四五六七八九十\p{Nd}]"

# page furniture, by stripped line
FURNITURE = (rf"^第{WS}*{DIGIT}+{WS}*页$", rf"^共{WS}*{DIGIT}+{WS}*页$", r"^[IVXLC]+$", r"^https?://", r"^.{0,10}大学.{0,10}硕士学位论文$")
PAGE_NUMBER = rf"^{DIGIT}+$"
PAGE_NUMBER_BELOW = 5

# characters a clean text consists of
VALID = r"\x{4e00}-\x{9fff}\x{3000}-\x{303f}\x{ff00}-\x{ffef}a-zA-Z0-9" + WS[1:-1] + r".,!?;:\"'()\[\]{}。，、！？；：「」『』（）【】《》〈〉—…·\-–_/\\+=*@#$%^&|~`<>"
CONTROL = r"[\x{0}-\x{8}\x{b}-\x{c}\x{e}-\x{1f}\x{7f}]"
DOUBLED_END = rf"([。！？；]){WS}*([。！？；])"

CHAPTER_ANYWHERE = rf"第{NUMERAL}+章"
CHAPTER_LINE = (rf"(?m)^#{{1,6}}{WS}+.*章", "(?m)^绪论", "(?m)^导论", "(?m)^引言", "(?m)^绪言")
ENDINGS = ("参考文献", "致谢", "附录")
MAX_GARBLED, ERROR_GARBLED, MIN_CHINESE, MIN_CHARS = 0.01, 0.05, 0.30, 1000
DIRTY = (rf"[A-Za-z](?:{WS}+[A-Za-z]){{4,}}", r"[\x{fffd}\x{0}-\x{8}]{3,}", rf"https?://{WS}+", r"。{3,}|！{3,}|？{3,}|；{3,}")

# segmentation
HEADER = (rf"^#{{1,6}}{WS}+", rf"^第{NUMERAL}+章", rf"^第{NUMERAL}+节", rf"^第{NUMERAL}+篇", rf"^{DIGIT}+\.{DIGIT}+{WS}+{NWS}", rf"^{DIGIT}+\.{DIGIT}+\.{DIGIT}+{WS}+{NWS}", rf"^{DIGIT}+\.{DIGIT}+\.{DIGIT}+\.{DIGIT}+{WS}+{NWS}")
DROPPED = (rf"^{WS}*目录{WS}*$", rf"^{WS}*图{WS}*{DIGIT}+{WS}*[.。…]+{WS}*{DIGIT}+$", rf"^{WS}*表{WS}*{DIGIT}+{WS}*[.。…]+{WS}*{DIGIT}+$", rf"^{WS}*作者简介", rf"^{WS}*攻读学位期间")
ROLES = {
    "intro": ("绪论", "引言", "导论", "绪言", "研究背景", "研究意义", "问题提出"),
    "literature": ("文献综述", "理论基础", "相关研究", "国内外研究", "研究现状"),
    "methodology": ("研究方法", "研究设计", "数据", "样本", "问卷", "实证设计", "模型", "变量"),
    "findings": ("研究结果", "实证结果", "数据分析", "描述性统计", "回归结果", "假设检验"),
    "discussion": ("讨论", "结果讨论", "理论贡献", "实践启示", "管理启示"),
    "conclusion": ("结论", "总结", "研究结论", "主要发现"),
    "limitation": ("局限", "不足", "研究局限", "未来研究"),
    "reference": ("参考文献", "文献"),
    "appendix": ("附录", "附表", "附图", "调查问卷"),
    "acknowledgement": ("致谢", "感谢"),
    "abstract": ("摘要", "abstract"),
}
CITATION = rf"\[{DIGIT}+\]|\({WS}*{DIGIT}{{4}}{WS}*\)|et{WS}+al"
FORMULA = r"[\$=∑∏∫√∂∆αβγδεθλμσπω]"
TABLE_REF, FIGURE_REF = rf"表{WS}*{DIGIT}+", rf"图{WS}*{DIGIT}+"
SENTENCE_END = r"[。！？；.!?]"
SHORT_BODY, MIN_LENGTH, MAX_LENGTH = 15, 20, 2000
UNKNOWN_CHAPTER = "未知章节"

# metadata
SCHOOL = (rf"({NWS}+大学)", rf"({NWS}+学院)", rf"({NWS}+研究院)")
MAJOR = (rf"专业{WS}*[:：]?{WS}*({NWS}+?)(?:{WS}|$)", rf"学科{WS}*[:：]?{WS}*({NWS}+?)(?:{WS}|$)", r"(工商管理硕士|MBA|EMBA)", rf"研究方向{WS}*[:：]?{WS}*({NWS}+?)(?:{WS}|$)")
AUTHOR = (rf"作者{WS}*[:：]?{WS}*({NWS}+?)(?:{WS}|$)", rf"研究生{WS}*[:：]?{WS}*({NWS}+?)(?:{WS}|$)", rf"姓名{WS}*[:：]?{WS}*({NWS}+?)(?:{WS}|$)")
CHAPTER_HEAD = rf"^第{NUMERAL}+章|^#{{1,6}}{WS}+"

# splits
YEARS = {"train": (2015, 2020), "dev": (2021, 2022), "test": (2023, 2024)}
HARD_ROLES = ("methodology", "discussion", "findings")
HARD_RATIO = 0.3

# variants
EXCLUDED_ROLES = ("reference", "limitation", "acknowledgement", "appendix")
VARIANT_TYPES = ("hard_human", "multi_round_rewrite", "partial_rewrite", "back_translation_mix", "polish_manual_mix", "standard_rewrite")
TEMPERATURE = {"hard_human": 0.4, "multi_round_rewrite": 0.7, "partial_rewrite": 0.6, "back_translation_mix": 0.6, "polish_manual_mix": 0.5, "standard_rewrite": 0.5}

# online statistics
PRONOUNS = ("我", "你", "他", "她", "它", "我们", "你们", "他们")
CONJUNCTIONS = ("和", "与", "或", "但是", "然而", "因此", "因为", "所以")
FORMAL = ("研究", "分析", "策略", "管理", "企业", "市场", "发展")

# fusion
MODELS = ("select5_tree_d2", "select10_tree_d2", "select15_tree_d3", "select20_tree_d2", "bert_tree_d1")
MODES = {"sensitive": 0.30, "balanced": 0.35, "strict": 0.45}
CALIBRATED = {"select5_tree_d2": 0.50, "select10_tree_d2": 0.50, "select15_tree_d3": 0.50, "select20_tree_d2": 0.50, "bert_tree_d1": 0.40}
CALIBRATION = 0.3
RISKS = ((0.15, "低风险"), (0.30, "中风险"), (0.50, "较高风险"))
HIGHEST_RISK = "高风险"
