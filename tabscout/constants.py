"""Sizes, limits, word lists and patterns that results depend on."""

# --- fixed values: byte windows and line bounds ---
DEFAULT_HEAD_BYTES = 4096
DEFAULT_TAIL_BYTES = 4096
MAX_WINDOW_BYTES = 16384
MAX_HEAD_LINES = 15
MAX_TAIL_LINES = 10
STREAM_CHUNK_BYTES = 64 * 1024
MAX_FORWARD_SCAN_BYTES = 64 * 1024 * 1024
RANGE_CHUNK_BYTES = 256 * 1024

# --- fixed values: grounding ---
CANDIDATE_DELIMITERS = (",", ";", "\t", "|")
MIN_AGREEING_LINES = 2
DOMINANCE_RATIO = 1.5
MIN_SUBSTRING_ANCHOR = 8
TOTALS_LABEL = r"(?:sub\s*-?\s*)?(?:grand\s+)?(?:totals?|totales|suma|sum)"
INTEGER = r"[+-]?\d+"
DECIMAL = r"[+-]?(?:\d{1,3}(?:[.,]\d{3})+|\d*)[.,]\d+"
DATE = r"\d{4}-\d{1,2}-\d{1,2}(?:[ T]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?)?|\d{1,2}[/.-]\d{1,2}[/.-](?:\d{4}|\d{2})"
BOM_CODECS = ("utf-8-sig", "utf-16", "utf-32")

# --- fixed values: answers ---
TAB_SPELLINGS = ("\\t", "tab")
NO_CHARACTER_SPELLINGS = ("", "null", "none")
ANSWER_FIELDS = ("encoding", "delimiter", "quotechar", "escapechar", "doublequote", "has_header", "header_row_index", "footer_first_line", "columns", "confidence")
ANCHOR_MAX_CHARS = 300
FENCED_OBJECT = r"```(?:json)?\s*(\{.*\})\s*```"

# --- fixed values: prompts and calls ---
CHARS_PER_TOKEN = 1.81
CONTEXT_STEPS = (8192, 16384, 32768)
REPLY_FLOOR, REPLY_BASE, REPLY_PER_FIELD = 448, 32, 20
PRIMARY_SHARE = 0.7
RETRY_STATUSES = (429, 503)
RETRY_DELAY_SECONDS, RETRY_JITTER, MAX_RETRY_AFTER_SECONDS, MIN_RETRY_BUDGET_SECONDS = 1.0, 0.2, 10.0, 1.0
RATE_WINDOW_SECONDS = 60

# --- fixed values: host limits ---
HOST_MIN_HEAD_BYTES = 512
HOST_MAX_BODY_BYTES = 256 * 1024 * 1024
HOST_SLOTS, HOST_QUEUE_SECONDS, HOST_TIMEOUT_SECONDS, HOST_MAX_TIMEOUT_SECONDS = 4, 10.0, 60.0, 300.0
MODEL_NAME = r"[A-Za-z0-9][A-Za-z0-9._:/@-]{0,199}"
OBJECT_URI = r"gs://[a-z0-9][a-z0-9._-]{1,220}[a-z0-9]/[^\r\n]{1,1024}"
REQUEST_ID = r"[\x21-\x7e]{1,128}"

# --- fixed values: evaluation ---
RESULT_FIELDS = ("encoding", "delimiter", "quotechar", "escapechar", "doublequote", "has_header", "header_row_index", "footer_lines", "footer_rows_to_skip", "columns")
COMPARABLE_FIELDS = (*RESULT_FIELDS, "expected_error")
NULL_SCORED_FIELDS = ("escapechar",)
ERROR_ANSWER, MATCH_ANSWER = "<error>", "<match>"
