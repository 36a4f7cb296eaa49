"""Fixed values. Results must agree on these, so they are stated here once, as they are."""

# Splitting: seed and ratios in per mille.
SEED = 42
SPLITS = ("train", "dev", "test")
TRAIN_PERMILLE = 400
DEV_PERMILLE = 200
TEST_PERMILLE = 400

# Content hash: leading hex characters of SHA-256 kept as the artifact id.
ARTIFACT_HASH_LENGTH = 16

# Hash scorer: accuracy in per mille is min(950, 300 + 5 * (hash mod 100)).
HASH_SCORER_BASE = 300
HASH_SCORER_STEP = 5
HASH_SCORER_MODULUS = 100
HASH_SCORER_CEILING = 950
WRONG_PREFIX = "wrong_"

# Retries: temperature of each attempt.
RETRY_TEMPERATURES = (0.0, 0.4, 0.7, 0.9)
MAX_RETRIES = 4

# Sample sizes and text lengths.
ERROR_SAMPLES = 10
ERROR_INPUT_CHARS = 500
DIGEST_INPUT_CHARS = 200
HISTORY_FULL_COUNT = 5
COMPACT_RATIONALE_CHARS = 100
REPORT_RATIONALE_CHARS = 50
GAP_TREND_LENGTH = 20
NOTES_FULL_CHARS = 2000
NOTES_TAIL_CHARS = 1000

# Gates and alarms.
EXAMPLES_MINIMUM = 200
EXAMPLES_WANTED = 1000
ARTIFACT_MAX_BYTES = 100_000
GAP_HEALTHY = 0.05
GAP_WARNING = 0.10
WIN_RATE_ALARM = 0.20

# Metric symbols.
METRIC_SYMBOLS = {"kappa": "κ", "f1": "F1", "spearman": "ρ"}

# Delimiters and patterns of response texts.
CANDIDATE_DELIMITER = "--- CANDIDATE ---"
PLAN_ID_PATTERN = r"plan_id:\s*(\S+)"
RATIONALE_PATTERN = r"(?s)rationale:\s*(.+?)(?:<PROMPT>|$)"
PROMPT_PATTERN = r"(?s)<PROMPT>\s*\n?(.*?)\n?\s*</PROMPT>"
UNKNOWN_PLAN = "unknown"
SELECT_ITER_PATTERN = r'"?iter=(\d+)"?'
SELECT_MERGE_PATTERN = r'"?merge=(\d+(?:\s*,\s*\d+)*)"?'
SELECT_RATIONALE_PATTERN = r"(?i)(?:because|rationale|reason)[:\s]+(.+)"
DEFAULT_RATIONALE = "Default selection"

# Formats of texts built from rows.
DIGEST_ENTRY = "Example %s:\n  Input: %s\n  Prediction: %s\n  Ground Truth: %s\n"
MISSING = "N/A"
HISTORY_FULL = (
    "--- iter=%s batch=%s parent=%s plan=%s ---\nRationale: %s\nMetrics: train: κ=%s dev: κ=%s\n"
    "Artifact:\n<PROMPT>\n%s\n</PROMPT>%s"
)
HISTORY_SUMMARY = "\nStage-A summary: %s"
HISTORY_COMPACT = "iter=%s batch=%s parent=%s plan=%s train-κ=%s dev-κ=%s rationale=%s..."
NO_PARENT = "None"

# Notebook headings and formats.
USER_HEADING = "## USER"
NOTES_EMPTY = "No notebook content."
NOTES_TITLE = "=== NOTEBOOK ==="
NOTES_CONSTRAINTS = "### User Constraints"
NOTES_FULL = "### Full Content"
NOTES_RECENT = "### Recent Content (last 1000 chars)"
