"""Fixed values and job parameters."""

from __future__ import annotations

from dataclasses import dataclass

# ---- fixed values: severity scores -------------------------------------------------------------------------------
SEVERITY_SCORES_CPPCHECK = {
    "critical": 4, "error": 3, "warning": 2, "performance": 2, "portability": 2, "style": 1, "information": 1,
}
SEVERITY_SCORES_CLANG = {"critical": 4, "error": 3, "warning": 2, "note": 1, "information": 1}

# ---- fixed values: keyword vocabularies (case-insensitive substrings) ---------------------------------------------
KEYWORDS_CPPCHECK = {
    "is_null_pointer": ["null pointer", "nullpointer", "null"],
    "is_buffer_issue": ["buffer", "overflow", "overrun"],
    "is_memory_issue": ["memory", "memleak", "leak", "free", "dereference"],
    "is_obsolete_function": ["gets", "strcpy", "strcat", "sprintf"],
}
KEYWORDS_CLANG = {
    "is_null_pointer": ["null pointer", "nullpointer"],
    "is_buffer_issue": ["buffer", "overflow", "overrun", "out of bounds"],
    "is_memory_issue": ["memory", "leak", "free", "dereference", "use after free", "double free"],
    "is_obsolete_function": ["gets", "strcpy", "strcat", "sprintf"],
}
RISKY_TERMS = [
    "strcpy", "strcat", "sprintf", "vsprintf", "gets", "memcpy", "memmove", "malloc", "calloc", "realloc", "free",
    "buffer", "overflow", "pointer", "null", "race", "system", "exec",
]

# ---- fixed values: labels and ranks ------------------------------------------------------------------------------
LABEL_OF_PRIORITY = {"LOW": 0, "MEDIUM": 1, "HIGH": 2}
PRIORITY_OF_LABEL = {0: "LOW", 1: "MEDIUM", 2: "HIGH"}
RANK_OF_PRIORITY = {"LOW": 1, "MEDIUM": 2, "HIGH": 3}
RANK_OF_LEVEL = {"LOW": 1, "MEDIUM": 2, "REVIEW_REQUIRED": 3, "HIGH": 4}
LABELS = [0, 1, 2]

# ---- fixed values: CWE families ----------------------------------------------------------------------------------
MEDIUM_FAMILY = "CWE476_NULL_Pointer_Dereference"
HIGH_FAMILIES = [
    "CWE121_Stack_Based_Buffer_Overflow",
    "CWE122_Heap_Based_Buffer_Overflow",
    "CWE415_Double_Free",
    "CWE416_Use_After_Free",
]

# ---- fixed values: files and alert ids ---------------------------------------------------------------------------
SOURCE_EXTENSIONS = [".c", ".cpp", ".cc", ".cxx", ".h", ".hpp"]
EXCLUDED_FOLDERS = [".git", "reports", ".devsecops"]
IGNORED_ALERT_IDS = ["checkersReport", "missingIncludeSystem", "missingInclude"]
BLANK_WORDS = ["", "nan", "none", "null"]
TRUE_WORDS = ["1", "true", "yes", "y"]

# ---- fixed values: anomaly features and statuses -----------------------------------------------------------------
ANOMALY_FEATURES = [
    "total_files_scanned", "total_alerts", "high_alerts", "medium_alerts", "low_alerts", "high_commit_risk",
    "medium_commit_risk", "low_commit_risk", "alerts_per_file",
]
UPSTREAM_STATUS_COLUMNS = ["commit_risk_status", "commit_summary_status", "cppcheck_status", "clang_status"]
BAD_STATUSES = ["MISSING", "MALFORMED", "SCHEMA_MISMATCH"]
PERTURBATION = {
    "total_alerts_multiplier": (2.0, 4.0),
    "high_alerts_increment": (3, 15),
    "high_commit_risk_increment": (2, 10),
    "alerts_per_file_multiplier": (2.0, 3.0),
    "total_files_scanned_shrink_ratio": (0.35, 0.7),
}

# ---- fixed values: required columns and model features -----------------------------------------------------------
REQUIRED_REPORT_COLUMNS = {
    "commit_risk_status": ["risk_level"],
    "commit_summary_status": ["total_changed_files"],
    "cppcheck_status": ["priority"],
    "clang_status": ["priority"],
}
FLAG_COLUMNS = ["is_null_pointer", "is_buffer_issue", "is_memory_issue", "is_obsolete_function"]
FEATURES_CPPCHECK = ["severity_score", "has_cwe", *FLAG_COLUMNS, "is_cppcheck", "alert_id", "severity", "cwe", "message"]
FEATURES_CLANG = ["severity_score", "has_cwe", *FLAG_COLUMNS, "is_clang", "alert_id", "severity", "message"]

# ---- fixed values: duplicate keys --------------------------------------------------------------------------------
ALERT_KEY_CPPCHECK = [
    "tool", "file", "line", "alert_id", "cwe", "severity", "message", "is_actionable", "priority", "label",
]
ALERT_KEY_CLANG = ["juliet_case_id", "source_file", "line", "alert_id", "severity", "message", "label"]
ANNOTATION_KEY = ["juliet_case_id", "source_file", "line", "alert_id", "cwe", "severity", "message"]

SEED = 42
DEFAULT_MIN_ROWS = 30


@dataclass(frozen=True)
class RiskParams:
    """Thresholds of the commit-risk scoring; checked when the job is declared, before any task runs."""

    medium_threshold: float = 40.0
    high_threshold: float = 70.0
    review_confidence: float = 0.2

    def __post_init__(self) -> None:
        if self.medium_threshold >= self.high_threshold:
            raise ValueError("medium-threshold must be lower than high-threshold")
        if not 0 <= self.review_confidence <= 1:
            raise ValueError("review-confidence-threshold must be between 0 and 1")


def min_rows_or_default(value: object) -> int:
    """A positive whole number, else the default of 30."""
    try:
        parsed = int(str(value).strip())
    except ValueError:
        return DEFAULT_MIN_ROWS
    return parsed if parsed > 0 else DEFAULT_MIN_ROWS
