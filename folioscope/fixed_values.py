"""Fixed values. They must equal what users get today, so they are stated as is."""

# Words that mark a paper as a survey-type paper (substring match, lower case).
SURVEY_WORDS = ("survey", "review", "tutorial", "overview")

# Cue words of the insight bonus, by language route.
CUES_EN = (
    "first",
    "novel",
    "breakthrough",
    "significant",
    "propose",
    "achieve",
    "solve",
    "improve",
)
CUES_ZH = ("首次", "突破", "显著", "创新", "解决", "提出", "新方法", "性能提升")

# Insight bonus, in tenths of a point, and the length bands (inclusive).
CUE_TENTHS = 3
BAND_TENTHS = 5
CAP_TENTHS = 20
BAND_EN = (50, 150)
BAND_ZH = (30, 100)

# Text and list limits.
FULL_TEXT_CHARS = 12_000
OUTLINE_CHARS = 18_000
NEWEST_LIMIT = 200

# Identifiers and links.
PAPER_KEY_PREFIX = "arvix_"
ABSTRACT_PAGE = "https://arxiv.org/abs/"
PDF_PAGE = "https://arxiv.org/pdf/"

# Author profiles.
UNKNOWN_AUTHOR = "Unknown"
FLAT_SOURCE = "semantic_scholar"
NESTED_SOURCE = "openalex"
NO_SOURCE = "none"
NOT_AVAILABLE = "N/A"

# Texts shown in results.
INSIGHT_FAILED = "（LLM 提取失败）"
NO_TRANSLATION = "暂无译文"
NO_MINDMAP = "暂无脑图"
LABEL_ZH = "中文"
LABEL_OTHER = "English"
REPORT_GUIDE_HEADING = "### 📘 导读（Why it matters）"
REPORT_TRANSLATION_HEADING = "### 🌐 译文（Abstract Translation）"
REPORT_MINDMAP_HEADING = "### 🧠 脑图（Mind Map）"

# Column order of the CSV export.
CSV_COLUMNS = (
    "id",
    "title",
    "published",
    "final_score",
    "total_score",
    "insight_bonus",
    "innovation",
    "rigor",
    "impact",
    "language",
    "breakthrough",
    "abstract",
)
