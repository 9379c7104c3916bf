"""Fixed values.

Everything in this module must equal the published values for results to be
right: word lists, patterns, thresholds, identifiers and texts.  They are the
defaults of parameters; no logic lives here.
"""

# ---- task names --------------------------------------------------------------
TASK_SPAM = "spam-classification"
TASK_PHISHING = "phishing-classification"
TASK_DRAFT = "email-drafting"
TASK_REWRITE = "email-rewrite"
TASK_SUMMARY = "thread-summary"
TASK_SEARCH = "semantic-search"
TASK_PRIORITY = "priority-ranking"
TASK_ANOMALY = "admin-anomaly-detection"
TASK_FEEDBACK = "feedback-ingestion"
TASKS = (
    TASK_SPAM,
    TASK_PHISHING,
    TASK_DRAFT,
    TASK_REWRITE,
    TASK_SUMMARY,
    TASK_SEARCH,
    TASK_PRIORITY,
    TASK_ANOMALY,
    TASK_FEEDBACK,
)

# ---- term lists of the heuristic scorers ---------------------------------------
SPAM_TERMS = ("free", "buy now", "offer", "discount", "winner", "unsubscribe")
PHISHING_TERMS = ("verify", "password", "login", "urgent action", "security alert", "wire transfer")
FALLBACK_SPAM_TERMS = ("buy now", "free", "winner", "limited time")
FALLBACK_PHISHING_TERMS = ("verify account", "password", "login now", "wire transfer")
PROMOTIONAL_TERMS = ("free", "buy now", "discount", "offer")
URGENCY_TERMS = ("urgent", "act now", "limited time")
CREDENTIAL_TERMS = ("verify account", "password", "login", "credential")
IMPERSONATION_TERMS = ("ceo", "finance team", "security department")
PRIORITY_TERMS = ("urgent", "deadline", "today")

# ---- word lists of the priority features ---------------------------------------
URGENCY_WORDS = ("urgent", "asap", "immediately", "deadline", "today", "emergency")
MEETING_WORDS = ("meeting", "call", "schedule", "calendar", "invite", "standup", "sync")
ACTION_PHRASES = ("please", "could you", "can you", "follow up", "kindly", "need you")
ATTACHMENT_WORDS = ("attached", "attachment", "see file", "enclosed", "document", "spreadsheet")
PRIORITY_LABELS = ("low", "medium", "high")
PRIORITY_SCORES = (0.2, 0.5, 0.9)

# ---- safety ------------------------------------------------------------------
INJECTION_PATTERNS = (
    r"ignore\s+previous\s+instructions",
    r"system\s+prompt",
    r"jailbreak",
    r"<script",
    r"169\.254\.169\.254",
)
FLAG_CONTROL = "control-characters-sanitized"
FLAG_INJECTION = "prompt-injection-suspected"
FLAG_TRUNCATED = "input-truncated"
FLAG_OVERRIDDEN = "action-overridden-by-safety"
BLOCKED_ACTION = "execute-system-command"
REVIEW_ACTION = "review"
SAFETY_MAX_BYTES = 8000

# ---- text cleaning -----------------------------------------------------------
EMAIL_MASK, URL_MASK, PHONE_MASK = "<EMAIL>", "<URL>", "<PHONE>"
CLEAN_MAX_CHARS = 4096
REQUEST_MAX_CHARS = 8000
REQUEST_FIELDS = ("text", "subject", "body", "instruction", "tone", "thread", "query")
MIN_RECORD_CHARS = 10
MIN_DIALOGUE_CHARS, MIN_SUMMARY_CHARS = 50, 10
MAX_DIALOGUE_CHARS, MAX_SUMMARY_CHARS = 2048, 512

# ---- labels and column guessing ------------------------------------------------
POSITIVE_LABELS = ("1", "true", "yes", "spam", "junk", "phishing", "malicious")
NEGATIVE_LABELS = ("0", "false", "no", "ham", "legitimate", "safe", "not spam")
TEXT_COLUMN_CANDIDATES = ("text", "message", "email", "content", "body")
LABEL_COLUMN_CANDIDATES = ("label", "target", "class", "spam")

# ---- tenant policy and routing -------------------------------------------------
PRIMARY_MODEL = "local-primary-v1"
FALLBACK_MODEL = "local-fallback-safe-v1"
MODEL_VERSION = "1.0.0"
CALIBRATION_TAG = "isotonic-baseline-v1"
DEFAULT_SPAM_THRESHOLD = 0.8
DEFAULT_PHISHING_THRESHOLD = 0.75
DEFAULT_MIN_CONFIDENCE = 0.86
FALLBACK_SPAM_CONFIDENCE = 0.95
FALLBACK_PHISHING_CONFIDENCE = 0.96

# ---- answers of the primary model, by task ---------------------------------------
CONFIDENCE = {
    TASK_DRAFT: 0.92,
    TASK_REWRITE: 0.93,
    TASK_SUMMARY: 0.9,
    TASK_SEARCH: 0.85,
    TASK_PRIORITY: 0.82,
    TASK_ANOMALY: 0.84,
    TASK_FEEDBACK: 1.0,
}
EXPLANATIONS = {
    TASK_SPAM: ("content pattern analysis", "sender/wording heuristic embedding"),
    TASK_PHISHING: ("link/authentication signal analysis", "impersonation phrase detection"),
    TASK_DRAFT: ("instruction-conditioned draft generation",),
    TASK_REWRITE: ("tone-aware rewrite",),
    TASK_SUMMARY: ("extractive summary pipeline",),
    TASK_SEARCH: ("embedding retrieval baseline",),
    TASK_PRIORITY: ("priority signal aggregation",),
    TASK_ANOMALY: ("tenant anomaly baseline",),
    TASK_FEEDBACK: ("feedback accepted",),
}
FALLBACK_EXPLANATIONS = {
    TASK_SPAM: ("fallback conservative spam scorer",),
    TASK_PHISHING: ("fallback conservative phishing scorer",),
}
ANOMALY_SCORE = 0.1
FEEDBACK_STATUS = "accepted"
DRAFT_DEFAULT_INTENT = "follow up"
DRAFT_TEMPLATE = (
    "Hi,\n\nThanks for reaching out. I have reviewed your note about %s and will follow up"
    " with the next steps shortly.\n\nBest regards,"
)
REWRITE_DEFAULT = "Thank you for your message."
REWRITE_FRIENDLY = "Thanks so much for your message — I really appreciate it."
REWRITE_FORMAL = "Thank you for your message. I appreciate your correspondence."
SUMMARY_MAX_BYTES, SUMMARY_CUT_BYTES, SUMMARY_TAIL = 180, 177, "..."

# ---- usage estimate ------------------------------------------------------------
OUTPUT_TOKENS, COST_USD, BYTES_PER_TOKEN = 128, 0.0005, 4

# ---- request admission ---------------------------------------------------------
RATE_LIMIT_PER_MINUTE = 120
MAX_REQUEST_BYTES = 1 << 20
REASON_MISSING_TENANT = "errors_missing_tenant"
REASON_RATE_LIMITED = "rate_limited"
REASON_BAD_JSON = "errors_bad_json"
REASON_MISSING_PAYLOAD_TENANT = "errors_missing_payload_tenant"
REASON_TENANT_MISMATCH = "errors_tenant_mismatch"
COUNTER_TOTAL = "requests_total"

# ---- jobs ----------------------------------------------------------------------
JOB_QUEUED, JOB_RUNNING, JOB_COMPLETED, JOB_FAILED = "queued", "running", "completed", "failed"

# ---- data sets and validation ----------------------------------------------------
DOMAINS = ("spam", "phishing", "summarization", "priority")
SPLITS = ("train", "val", "test")
SPLIT_RATIOS = (0.80, 0.10, 0.10)
SPLIT_SEED = 42
VALIDATE_MIN_CHARS = 5
MAX_IMBALANCE_RATIO = 20.0
MAX_DUPLICATE_RATE = 0.10

# ---- promotion gates -----------------------------------------------------------
GATES = {
    TASK_SPAM: (0.90, 0.85, 0.88),
    TASK_PHISHING: (0.92, 0.88, 0.90),
}
MIN_ROUGE1 = 10.0
