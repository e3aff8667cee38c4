"""Fixed values.

Everything in this file is data, not logic: patterns, templates, thresholds and
lookup entries that have to hold exactly these values for results to be right.
"""

# Case-blind patterns that mark a text as boilerplate.
BAD_PATTERNS = [
    r"free shipping",
    r"shipping policy",
    r"add to cart",
    r"\bcart\b",
    r"\bsku\b",
    r"lost your password",
    r"please enter your email address",
    r"please briefly explain why",
    r"report this question",
    r"report this answer",
    r"get access to:",
    r"privacy policy",
    r"cookie policy",
    r"terms of use",
    r"all rights reserved",
    r"email@example\.com",
    r"subscribe to our newsletter",
    r"enable javascript",
]

# Corpus quality thresholds.
SCORE_MIN = 0.95
MIN_CHARS = 1200
MAX_CHARS = 20000
MIN_WORDS = 220
MAX_BULLET_LINE_FRAC = 0.45
BULLET_MIN_LINES = 20
PREFIX_CHARS = 500

# Position sampling.
MIN_POSITION = 50
POSITIONS_PER_DOC = 10

# Document split fractions, in routing order.
SPLIT_FRACTIONS = {"av_sft": 0.3, "ar_sft": 0.3, "rl": 0.4}

# Tags and templates of the training tables.
EXPLANATION_OPEN = "<explanation>"
EXPLANATION_CLOSE = "</explanation>"
INJECT_PLACEHOLDER = "<INJECT>"
CRITIC_TEMPLATE = "Summary of the following text: <text>{explanation}</text> <summary>"
ACTOR_TEMPLATE = """You are a meticulous AI researcher conducting an important investigation into activation vectors from a language model. Your overall task is to describe the semantic content of that activation vector.

We will pass the vector enclosed in <concept> tags into your context. You must then produce an explanation for the vector, enclosed within <explanation> tags. The explanation consists of 2-3 text snippets describing that vector.

Here is the vector:

<concept>{injection_char}</concept>

Please provide an explanation."""

# Cleaning of provider responses.
RESPONSE_PATTERN = r"<analysis>\s*(.*?)\s*</analysis>"
MIN_FEATURES = 2
LIST_PREFIX = (
    r"^\s*(?:[-*•+–—]|\d+[.)]|\(\d+\)|[a-zA-Z][.)]|\([a-zA-Z]\)|[ivxIVX]+[.)])\s+"
)
BOLD_WRAP = r"^\*\*(.+?)\*\*\s*"
HEADER_PHRASES = [
    r"Second",
    r"Final feature",
    r"Final token",
    r"Final word",
    r"The final (?:token|word)",
    r"Immediate syntactic constraint",
    r"Semantic topic continuation",
    r"Semantic expectation",
    r"Syntactic expectation",
    r"Syntactic/structural (?:constraint|constraints)",
    r"Immediate semantic expectations?",
    r"Stylistic/register(?: patterns?)?",
    r"Narrative/argumentative momentum",
    r"Domain/genre signals?",
    r"Repetition/continuation patterns?",
]
ORDINAL_WORDS = r"Second|Third|Finally"
FINAL_PHRASES = r"Semantic expectation|The final token|The final word"
SENTENCE_END = r"[.!?]"
SENTENCE_START = "[A-Z\"`]"

# Lowest share of rows an exact reuse join has to match.
MIN_MATCH_SHARE = 0.95

# Code point range the marker character is picked from.
MARKER_FIRST = 0x3200
MARKER_LAST = 0x33FF

# Rewards and vector scaling.
NORM_FLOOR = 1e-12
MSE_FLOOR = 1e-8
FAILED_REWARD = -2.0
SCALE_SQRT_WIDTH = "sqrt_d_model"
SCALE_RAW = ["raw", "none"]
MAX_CRITIC_TOKENS = 512
UNTRAINED_HEAD_SCALE = 0.1
SCORE_AGREEMENT_TOLERANCE = 0.10

# Source labels by substring of the document id, first match wins.
SOURCE_LABELS = [("WildChat", "WildChat"), ("Ultra-FineWeb", "UFW")]
SOURCE_OTHER = "other"

# Report sizes.
REPORT_TOP = 6
REPORT_MID = 8
REPORT_BOTTOM = 6
REPORT_MAX_CHARS = 1800
REPORT_PERCENTILES = [10, 25, 50, 75, 90]

# Substrings that must not appear in released text.
PRIVATE_PATTERNS = ["gs://", "s3://", "/mnt/", "/tmp/", "iter_", "rollout_id"]

# Key renames and drops for released manifests.
RELEASED_ROLES = {"actor": "av", "critic": "ar"}
RELEASED_DROPS = ["rollout_id", "_name_or_path"]

# Model presets (name, layers, width, batch size, max length, device).
MODEL_PRESETS = [
    ("qwen7b", "Qwen/Qwen2.5-7B-Instruct", 28, 3584, 16, 4096, None),
    ("gemma12b", "google/gemma-3-12b-it", 48, 3840, 8, 4096, "cuda:0"),
    ("gemma27b", "google/gemma-3-27b-it", 62, 5376, 4, 4096, "cuda:0"),
    ("llama70b", "meta-llama/Llama-3.3-70B-Instruct", 80, 8192, 1, 4096, "auto"),
]

# Parquet rows per file or row group, chunk sizes.
ROWS_PER_FILE = 65536
EXPLAIN_CHUNK = 512
BUILD_CHUNK = 4096

# Manifest versions and stages.
MANIFEST_VERSION = 1
TRAINING_STAGES = ["av_sft", "ar_sft", "rl"]
