"""Rule data for classification, scoring, issue extraction, routing and redaction.

Rules are input data, not code: every operator takes a ``RuleSet`` and builds
its Column expressions from these ordered tables.  Order is meaningful
wherever the reference uses "first match wins" (title patterns, taxonomy,
severity words, PII patterns).
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# FIXED VALUES — must equal the reference's rule data for identical results.
# Stated plainly, in the reference's natural order.
# ---------------------------------------------------------------------------

VENDOR_EMAIL_DOMAINS = ["aegiscloud.com", "aegis.com"]

# (entity_type, pattern) — applied in this order, all case-insensitive.
PII_PATTERNS = [
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@(?!aegiscloud\.com)(?!aegis\.com)[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("PHONE", r"\b(\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"),
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("CREDIT_CARD", r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b"),
    ("IP_ADDRESS", r"\b(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b"),
    ("AWS_ACCESS_KEY", r"\bAKIA[0-9A-Z]{16}\b"),
    ("API_KEY", r"\bsk-ant-[A-Za-z0-9_\-]{20,}\b"),
    ("API_KEY", r"\bghp_[A-Za-z0-9]{36}\b"),
    ("AUTH_TOKEN", r"(?i)\bBearer\s+[A-Za-z0-9\-._~+/]{20,}=*\b"),
    ("PASSPORT_NO", r"\b[A-Z]{1,2}[0-9]{7,9}\b"),
]

CALL_TYPE_SUPPORT_PREFIX = r"^Support Case"
CALL_TYPE_EXTERNAL_PREFIX = r"^Aegis /"
CALL_TYPES = ["support", "external", "internal"]

# Level-1 category rules: (title regex, category), case-insensitive search.
CATEGORY_TITLE_PATTERNS = [
    (r"INCIDENT:|URGENT:|War Room|Pipeline Failure|Escalation Bridge|Detect Outage\s*-|Customer Impact Assessment|Remediation Plan|Complete Loss of|Cobalt Software - Aegis Detect", "Incident Response"),
    (r"Win/Loss|Competitive (?:Threat Assessment|Landscape|Response|Evaluation)", "Competitive Intelligence"),
    (r"SOC 2|ISO 27001|HIPAA|PCI|Audit Prep|Audit - Internal|SOC 2 Type", "Compliance & Audit"),
    (r"^Support Case", "Technical Support"),
    (r"Onboarding Kickoff|Deployment Kickoff|Identity Module Setup|Comply v2 Deployment", "Onboarding & Deployment"),
    (r"Multi-Year Renewal|Contract (?:Discussion|Review)|Renewal (?:Confirmation|Concerns|Discussion)|Q\d+ Planning", "Commercial & Renewal"),
    (r"Business Review|Account Review|Account Recovery|Service Reliability Discussion|Platform Concerns|Post-Incident Review|Detect (?:Recovery|Reliability)|Account Health", "Account Health & QBR"),
    (r"Product Feedback|Roadmap Review|Early Access", "Product Feedback & Roadmap"),
    (r"Standup|All Hands|Sprint Planning|Launch Readiness|Root Cause Analysis|30-Day Review|Architecture Review|Post-Mortem|Win/Loss Analysis|Reliability.*Review", "Internal Planning & Engineering"),
]

# Levels 2/3: (category, keywords) — substring match on lower-cased topics.
TAXONOMY = [
    ("Incident Response", ["outage", "incident", "p0", "war room", "customer impact", "remediation", "root cause", "pipeline failure", "blast radius", "critical failure", "complete loss", "service disruption"]),
    ("Technical Support", ["support case", "bug", "latency", "timeout", "crash", "performance", "degradation", "error", "api", "restore", "backup", "recovery", "slow", "intermittent"]),
    ("Compliance & Audit", ["compliance", "soc 2", "soc2", "iso 27001", "hipaa", "pci", "audit", "regulatory", "gdpr", "certification", "comply"]),
    ("Commercial & Renewal", ["renewal", "contract", "pricing", "billing", "license", "overage", "invoice", "discount", "seat", "multi-year", "upsell", "payment"]),
    ("Account Health & QBR", ["business review", "qbr", "account health", "account review", "post-incident review", "service reliability", "platform concerns", "churn", "retention", "at-risk", "escalation", "competitive"]),
    ("Competitive Intelligence", ["win/loss", "competitive", "competitor", "vendor comparison", "evaluation", "market", "landscape"]),
    ("Product Feedback & Roadmap", ["roadmap", "feature", "product feedback", "early access", "enhancement", "request", "wishlist", "gap"]),
    ("Onboarding & Deployment", ["onboarding", "deployment", "kickoff", "setup", "implementation", "migration", "integration", "configuration", "identity module", "saml", "sso", "provisioning", "scim"]),
    ("Internal Planning & Engineering", ["sprint", "standup", "all hands", "planning", "retro", "architecture", "launch", "backlog", "post-mortem", "root cause analysis", "engineering"]),
]
OTHER_CATEGORY = "Other"

CALL_TYPE_BASELINES = [("support", 2.94), ("external", 4.21), ("internal", 3.42)]
DEFAULT_BASELINE = 3.0
SENTIMENT_STD_DEV = 0.8
ANOMALY_Z_THRESHOLD = 1.5

# (category, severity) -> team
ESCALATION_RULES = [
    ("Incident Response", "p0", "engineering"),
    ("Incident Response", "p1", "engineering"),
    ("Technical Support", "p0", "engineering"),
    ("Compliance & Audit", "p0", "security"),
    ("Account Health & QBR", "p1", "account"),
    ("Commercial & Renewal", "p1", "cs"),
]
PAGER_SEVERITIES = ["p0", "p1"]

SEVERITY_WORDS = [
    ("p0", ["outage", "down", "critical", "breach", "data loss", "zero visibility"]),
    ("p1", ["degraded", "failing", "blocked", "urgent", "escalat", "sev1"]),
    ("p2", ["slow", "intermittent", "error", "bug", "discrepancy", "overage"]),
    ("p3", ["question", "inquiry", "request", "minor", "clarif"]),
]

FEATURE_GAP_KEYWORDS = ["roadmap", "feature request", "feature gap", "gap", "wishlist", "enhancement", "missing capability", "product feedback", "early access", "backlog", "not supported", "workaround needed"]
FEATURE_GAP_CATEGORY = "Product Feedback & Roadmap"

OUTAGE_KEYWORDS = ["outage", "incident", "escalation", "war room", "customer impact", "remediation", "post-incident", "detect outage", "platform outage"]

EXTERNAL_ACCOUNT_REGEX = r"^Aegis\s*/\s*(.+?)(?:\s+-\s+.+)?$"
SUPPORT_COMPANY_REGEX = r"Support Case #\d+\s*-\s*([A-Z][A-Za-z0-9& ]+?)\s+(?:Comply|Detect|Protect|Identity|Custom|Billing|Urgent|Question|Issue|Inquiry|Request|Ticket|Compliance|Threat|Module|Platform|Service|Account|API|SSO|SAML|SCIM|MFA|Report|Export|Dashboard|Audit|ISO|SOC|PCI)"
SUPPORT_COMPANY_FALLBACK_REGEX = r"Support Case #\d+\s*-\s*([A-Z][A-Za-z0-9&]+(?:\s+[A-Z][A-Za-z0-9&]+){0,2})"
EXTERNAL_TITLE_PREFIX = "Aegis / "

SUMMARY_MAX_CHARS = 500
KEY_MOMENTS_MAX = 5
ISSUE_TITLE_MAX_CHARS = 80

FEEDBACK_CALL_TYPES = ["support", "external", "internal"]
FEEDBACK_SENTIMENT_LABELS = ["positive", "mixed-positive", "mixed", "mixed-negative", "negative"]

SEARCH_K1 = 1.5
SEARCH_B = 0.75
SEARCH_TOP_K = 5
SEARCH_MAX_K = 20
EVAL_PASS_THRESHOLD = 0.90

# Risk score bands (points) for the churn radar.
RISK_SCORE_BANDS = [(2.5, 40), (3.0, 25), (3.5, 10)]
RISK_DROP_BANDS = [(1.5, 30), (1.0, 20), (0.5, 10)]
RISK_COMPETITOR_POINTS = 30
# --------------------------------------------------------------------------- end of fixed values


# A text that a PII pattern matches also matches its entry here, which is cheap to test (same flags).
# A pattern without an entry is its own condition.
PII_NEEDS = {
    PII_PATTERNS[0][1]: r"@",
    PII_PATTERNS[1][1]: r"\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}",
    PII_PATTERNS[2][1]: r"\d-\d{2}-\d",
    PII_PATTERNS[3][1]: r"[0-9]{13}",
    PII_PATTERNS[4][1]: r"\d\.\d{1,3}\.\d",
    PII_PATTERNS[5][1]: r"AKIA",
    PII_PATTERNS[6][1]: r"sk-ant-",
    PII_PATTERNS[7][1]: r"ghp_",
    PII_PATTERNS[8][1]: r"Bearer\s",
    PII_PATTERNS[9][1]: r"[A-Z][0-9]{7}",
}

# A text of ASCII characters that a PII pattern matches has its entry here: characters as a class, or a literal
# in any case that starts with a letter or digit.  Without an entry nothing is known, and the needs above decide alone.
PII_MARKS = {
    PII_PATTERNS[0][1]: "[@]",
    **{PII_PATTERNS[i][1]: "[0-9]" for i in (1, 2, 3, 4, 9)},
    PII_PATTERNS[5][1]: "akia",
    PII_PATTERNS[6][1]: "sk-ant-",
    PII_PATTERNS[7][1]: "ghp_",
    PII_PATTERNS[8][1]: "bearer",
}


@dataclass(frozen=True)
class RuleSet:
    """Ordered rule tables; pass a modified copy to change behaviour."""

    pii_patterns: list = field(default_factory=lambda: list(PII_PATTERNS))
    pii_needs: dict = field(default_factory=lambda: dict(PII_NEEDS))
    pii_marks: dict = field(default_factory=lambda: dict(PII_MARKS))
    vendor_email_domains: list = field(default_factory=lambda: list(VENDOR_EMAIL_DOMAINS))
    support_prefix: str = CALL_TYPE_SUPPORT_PREFIX
    external_prefix: str = CALL_TYPE_EXTERNAL_PREFIX
    title_patterns: list = field(default_factory=lambda: list(CATEGORY_TITLE_PATTERNS))
    taxonomy: list = field(default_factory=lambda: [(c, list(k)) for c, k in TAXONOMY])
    baselines: list = field(default_factory=lambda: list(CALL_TYPE_BASELINES))
    default_baseline: float = DEFAULT_BASELINE
    std_dev: float = SENTIMENT_STD_DEV
    z_threshold: float = ANOMALY_Z_THRESHOLD
    escalation_rules: list = field(default_factory=lambda: list(ESCALATION_RULES))
    pager_severities: list = field(default_factory=lambda: list(PAGER_SEVERITIES))
    severity_words: list = field(default_factory=lambda: [(s, list(w)) for s, w in SEVERITY_WORDS])
    feature_gap_keywords: list = field(default_factory=lambda: list(FEATURE_GAP_KEYWORDS))
    feature_gap_category: str = FEATURE_GAP_CATEGORY
    outage_keywords: list = field(default_factory=lambda: list(OUTAGE_KEYWORDS))
    external_account_regex: str = EXTERNAL_ACCOUNT_REGEX

    @property
    def categories(self) -> list:
        return [c for c, _ in self.taxonomy]


DEFAULT_RULES = RuleSet()
