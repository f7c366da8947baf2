"""Fixed values.

Word lists, patterns, templates and limits whose exact content decides the
result. They are data, not logic, and are kept together in natural order.
"""

# ---- task types and routing (fixed values) --------------------------------
TASK_TYPES = (
    "risk_summary",
    "mda_explanation",
    "metric_extraction",
    "yoy_comparison",
    "business_risk_identification",
    "revenue_driver_explanation",
    "filing_qa",
    "analyst_summary",
    "outlook_classification",
    "hallucination_detection",
)

SECTION_TASKS = {
    "business": (
        "business_risk_identification",
        "revenue_driver_explanation",
        "filing_qa",
        "analyst_summary",
        "outlook_classification",
    ),
    "risk_factors": (
        "risk_summary",
        "business_risk_identification",
        "filing_qa",
        "analyst_summary",
        "outlook_classification",
        "hallucination_detection",
    ),
    "mda": (
        "mda_explanation",
        "metric_extraction",
        "yoy_comparison",
        "revenue_driver_explanation",
        "filing_qa",
        "analyst_summary",
        "outlook_classification",
    ),
    "market_risk": (
        "metric_extraction",
        "business_risk_identification",
        "filing_qa",
        "analyst_summary",
        "hallucination_detection",
    ),
    "financial_statements": (
        "metric_extraction",
        "yoy_comparison",
        "filing_qa",
        "analyst_summary",
    ),
}

SPLITS = ("train", "validation", "test")

# section name -> item id (fixed values)
SECTION_ITEMS = {
    "business": "1",
    "risk_factors": "1a",
    "mda": "7",
    "market_risk": "7a",
    "financial_statements": "8",
}

# ---- keyword banks (fixed values) -----------------------------------------
YOY_TERMS = (
    "increase", "increased", "decrease", "decreased", "grew", "growth", "declined",
    "compared with", "compared to", "year over year", "year-over-year", "prior year",
    "fiscal year", "percentage", "basis points",
)
RISK_TERMS = (
    "risk", "risks", "uncertainty", "competition", "regulation", "supply chain",
    "cybersecurity", "litigation", "market", "inflation", "demand", "dependency",
    "disruption",
)
REVENUE_TERMS = (
    "revenue", "sales", "demand", "growth", "customer", "product", "segment", "pricing",
    "volume", "subscription", "services", "margin",
)
POSITIVE_TERMS = (
    "growth", "increased", "improved", "strong", "higher", "expansion", "profitability",
    "demand",
)
NEGATIVE_TERMS = (
    "risk", "decline", "decreased", "lower", "uncertainty", "inflation", "litigation",
    "weakness", "disruption", "loss",
)
STOPWORDS = (
    "the", "a", "an", "of", "to", "and", "or", "in", "on", "for", "with", "by", "from",
    "as", "at", "is", "are", "was", "were", "be", "been", "being", "this", "that",
    "these", "those", "it", "its", "their", "our", "your", "his", "her", "they", "we",
    "you", "i", "he", "she", "them", "us", "not", "no", "but", "if", "then", "than",
    "into", "over", "under", "about", "above", "below", "up", "down", "out",
)

# ---- patterns (fixed values) ----------------------------------------------
MONEY = r"\$\s?\d[\d,]*(?:\.\d+)?"
PERCENT = r"\d+(?:\.\d+)?\s?%"
MAGNITUDE = r"\d[\d,]*(?:\.\d+)?\s?(?:million|billion|trillion|thousand)"
BASIS_POINTS = r"\d+(?:\.\d+)?\s?basis points"
BARE_NUMBER = r"\b\d[\d,]*(?:\.\d+)?\b"
ANY_FIGURE = (
    r"\$\s?\d[\d,]*(?:\.\d+)?%?|\d+(?:\.\d+)?\s?%|\d[\d,]*(?:\.\d+)?\s?"
    r"(?:million|billion|trillion|thousand)|\b\d[\d,]*(?:\.\d+)?\b"
)
ITEM_HEADING = r"\bitem\s+(\d{1,2})\s*([a-z])?\b"
ARTICLES = r"\b(a|an|the)\b"
CHAT_TOKENS = r"</?s>|\[/?INST\]|<\|[^>]*\|>|<<SYS>>|<</SYS>>"
ADVISOR_SENTENCE = r"[\w-]+ is not a licensed financial advisor\.[^\n]*"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# ---- instructions and fixed answers (fixed values) ------------------------
INSTRUCTIONS = {
    "risk_summary": "Summarize the key risk factors discussed in the filing excerpt.",
    "mda_explanation": "Explain the main management discussion points in this MD&A excerpt.",
    "metric_extraction": (
        "Extract financial metrics, figures, percentages, or monetary values "
        "mentioned in the filing excerpt."
    ),
    "yoy_comparison": (
        "Identify any year-over-year comparison or period-over-period change "
        "mentioned in the filing excerpt."
    ),
    "business_risk_identification": (
        "Identify business risks or operational risks mentioned in the filing excerpt."
    ),
    "revenue_driver_explanation": (
        "Identify revenue drivers or business performance drivers mentioned "
        "in the filing excerpt."
    ),
    "filing_qa": (
        "Answer the following filing-grounded question using only the provided "
        "excerpt: What is the main point of this excerpt?"
    ),
    "analyst_summary": "Write a concise analyst-style summary of the filing excerpt.",
    "outlook_classification": (
        "Classify the financial or business outlook in the excerpt as positive, "
        "neutral, or negative. Explain briefly."
    ),
    "hallucination_detection": (
        "Determine whether the proposed answer is supported by the filing excerpt."
    ),
}
NO_CONTENT = "(no extractable content in excerpt)"
NO_METRIC = "No explicit financial metric was found in the provided excerpt."
NO_YOY = (
    "No explicit year-over-year or period-over-period comparison was "
    "found in the provided excerpt."
)
NO_RISK = "No explicit business or operational risk was found in the provided excerpt."
NO_DRIVER = "No explicit revenue driver was found in the provided excerpt."
FALSE_CLAIM = "The company guarantees future investment returns."
REASON_TRUE = "The proposed answer is a sentence taken directly from the excerpt."
REASON_FALSE = "The proposed answer is a generic claim not stated in the excerpt."
BASELINE_OUTLOOK = "The outlook is neutral based on the excerpt."
BASELINE_SUPPORTED = "The proposed answer is supported by the filing excerpt."
BASELINE_UNSUPPORTED = "The proposed answer is unsupported by the filing excerpt."
BASELINE_EMPTY = "No content available in the excerpt."

# ---- prompt texts (fixed values) ------------------------------------------
EVAL_SYSTEM = (
    "You are a financial filing analysis assistant. Answer using only the "
    "provided filing excerpt. If the answer is not supported by the excerpt, "
    "say so."
)
EVAL_CLOSING = "Provide a concise, filing-grounded answer."
REWRITE_CLOSING = "Return only the improved answer."

# ---- metrics per task (fixed values) --------------------------------------
TASK_METRICS = {
    "filing_qa": ("exact_match", "token_f1", "lexical_faithfulness"),
    "risk_summary": ("rouge_l", "token_f1", "lexical_faithfulness"),
    "mda_explanation": ("rouge_l", "token_f1", "lexical_faithfulness"),
    "metric_extraction": ("numeric_match", "token_f1", "lexical_faithfulness"),
    "yoy_comparison": ("rouge_l", "token_f1", "lexical_faithfulness"),
    "business_risk_identification": ("rouge_l", "token_f1", "lexical_faithfulness"),
    "revenue_driver_explanation": ("rouge_l", "token_f1", "lexical_faithfulness"),
    "analyst_summary": ("rouge_l", "token_f1", "lexical_faithfulness"),
    "outlook_classification": ("classification_accuracy", "token_f1"),
    "hallucination_detection": ("classification_accuracy", "lexical_faithfulness"),
}
DEFAULT_METRICS = ("token_f1", "lexical_faithfulness")
FAITHFULNESS_METRICS = (
    "lexical_faithfulness",
    "nli_faithfulness",
    "classification_accuracy",
)
SAMPLE_BACKENDS = ("mock", "sample", "fake")

# ---- corpus safety (fixed values) -----------------------------------------
SECRET_KEYS = (
    "API_SECRET_KEY",
    "SECRET_KEY",
    "HF_TOKEN",
    "ANTHROPIC_API_KEY",
    "OPENAI_API_KEY",
    "WANDB_API_KEY",
)
SECRET_ASSIGNMENT = "(" + "|".join(SECRET_KEYS) + r")\s*[:=]\s*([\"']?[^\s\"'#,)]+[\"']?)"
PLACEHOLDER_HINTS = (
    "change-me", "changeme", "your-", "your_", "xxx", "placeholder", "example", "dummy",
    "redacted", "<", "${", "...", "none", "test",
)
WEIGHT_SUFFIXES = (".safetensors", ".bin", ".pt", ".gguf", ".ckpt", ".pth")

# ---- request bounds (fixed values) ----------------------------------------
MAX_QUESTION_CHARS = 2_000
MAX_EXCERPT_CHARS = 100_000
MAX_NEW_TOKENS = 2_048
MAX_TEMPERATURE = 2.0
WINDOW_SECONDS = 60

# fixed values: kinds of files that are scanned for secrets
SECRET_SCAN_SUFFIXES = (".py", ".ts", ".tsx", ".js", ".sh", ".yaml", ".yml", ".json", ".toml", ".cfg", ".ini", ".env")
