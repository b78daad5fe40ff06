"""Parameters of the queries. The given texts are invented prose, so the words are too."""

from __future__ import annotations

from datetime import datetime

from folioscope.functions.language import LetterClass
from folioscope.functions.scoring import BonusRules, CueRule
from folioscope.plans.analysis import AnalysisConfig

EXCLUSIONS = ("license", "token", "worthless", "released")
KEYWORDS = ("retion", "ention", "edtion")
CATALOGUE_KEYWORDS = ("retion", "ention")
CATEGORIES = ("src1", "src2", "de")
CUES = (
    "thtion",
    "attion",
    "ertion",
    "thanea",
    "eriner",
    "thanedble",
    "ontion",
    "antion",
)
CUES_DE = (
    "nicht",
    "ensch",
    "ersch",
    "enver",
    "erung",
    "enein",
    "erver",
    "enlich",
)
BAND = (50, 150)
BAND_DE = (30, 100)
RULES = BonusRules(CueRule(CUES, BAND), {"de": CueRule(CUES_DE, BAND_DE)})
LANGUAGES = (
    LetterClass("de", "äöüßÄÖÜ"),
    LetterClass("es", "ñóÑÓáí"),
    LetterClass("fr", "çèêéÇÈÉÊ"),
)
FLOOR = 0.004
AS_OF = datetime(2024, 1, 31)
DAYS = 7
TOP_K = 20
HEAD_CAP = 20
GENERATED_AT = "2024-01-31T00:00:00"

CONFIG = AnalysisConfig(
    keywords=KEYWORDS,
    as_of=AS_OF,
    days=DAYS,
    top_k=TOP_K,
    exclusions=EXCLUSIONS,
    languages=LANGUAGES,
    language_floor=FLOOR,
    rules=RULES,
)
