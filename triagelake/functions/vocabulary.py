"""Fixed values of the classification rules.

The words decide which incident gets which label, so they are data that has to
stay exactly as it is. Order of the label map matters for partial matches.
"""

# --- fixed values -----------------------------------------------------------
CATEGORY_KEYWORDS = {
    "latency": [
        "latency", "slow", "timeout", "delay", "response time", "performance", "lag",
        "p99", "p95", "percentile", "slo", "sli", "degraded", "sluggish",
    ],
    "outage": [
        "outage", "down", "unavailable", "offline", "crash", "failure", "unreachable",
        "502", "503", "500", "service down", "not responding", "dead", "broken",
    ],
    "deployment": [
        "deploy", "deployment", "release", "rollout", "rollback", "upgrade", "version",
        "canary", "blue-green", "ci/cd", "pipeline", "build", "helm", "kubernetes deploy",
    ],
    "config": [
        "config", "configuration", "misconfiguration", "setting", "env",
        "environment variable", "yaml", "json", "toml", "properties", "secret",
        "credential", "flag", "feature flag",
    ],
    "capacity": [
        "capacity", "scale", "scaling", "memory", "cpu", "disk", "storage", "quota",
        "limit", "resource", "oom", "out of memory", "throttle", "autoscale", "hpa", "vpa",
    ],
    "data": [
        "data", "database", "db", "query", "sql", "migration", "schema", "replication",
        "backup", "restore", "corruption", "inconsistent", "deadlock", "transaction",
        "redis", "postgres", "mysql", "mongodb",
    ],
    "security": [
        "security", "vulnerability", "cve", "exploit", "breach", "unauthorized", "auth",
        "authentication", "authorization", "permission", "access", "ssl", "tls",
        "certificate", "injection", "xss",
    ],
    "dependency": [
        "dependency", "upstream", "downstream", "third-party", "external", "api",
        "integration", "vendor", "library", "package", "module", "import", "sdk", "client",
    ],
    "network": [
        "network", "dns", "tcp", "udp", "http", "https", "ssl", "connection", "socket",
        "port", "firewall", "load balancer", "proxy", "ingress", "egress", "vpc",
        "subnet", "route",
    ],
}

# A text with this many distinct keywords of one category is fully trusted.
FULL_CONFIDENCE_HITS = 3

LABEL_CATEGORIES = {
    "performance": "latency",
    "slow": "latency",
    "latency": "latency",
    "bug": "outage",
    "crash": "outage",
    "outage": "outage",
    "deployment": "deployment",
    "ci/cd": "deployment",
    "release": "deployment",
    "configuration": "config",
    "config": "config",
    "scaling": "capacity",
    "resources": "capacity",
    "memory": "capacity",
    "database": "data",
    "data": "data",
    "security": "security",
    "vulnerability": "security",
    "cve": "security",
    "dependency": "dependency",
    "upstream": "dependency",
    "network": "network",
    "networking": "network",
    "dns": "network",
}

# Tested from top to bottom; the first list with a hit decides.
SEVERITY_PHRASES = [
    ("critical", ["critical", "urgent", "emergency", "complete outage", "all users"]),
    ("high", ["high", "major", "severe", "production down", "data loss"]),
    ("medium", ["degraded", "slow", "intermittent", "some users"]),
    ("low", ["minor", "low", "cosmetic", "typo"]),
]
SEVERITY_DEFAULT = "medium"

ISSUE_SEVERITY_LABELS = [
    ("critical", ["critical", "priority/critical", "p0", "severity/critical"]),
    ("high", ["high", "priority/high", "p1", "severity/high", "important"]),
    ("medium", ["medium", "priority/medium", "p2", "severity/medium"]),
    ("low", ["low", "priority/low", "p3", "severity/low", "minor"]),
]
ISSUE_SEVERITY_PHRASES = [
    ("high", ["critical", "urgent", "emergency", "outage", "down"]),
    ("medium", ["important", "breaking", "regression"]),
]

# First pattern that occurs wins; both ignore case.
RESOLUTION_PATTERNS = [
    r"(?:fixed|resolved|closed) (?:by|in|via) #(\d+)",
    r"(?:root cause|solution|fix):\s*(.+?)(?:\n|$)",
]
RESOLUTION_PREFIX = "Referenced: "
# ----------------------------------------------------------------------------
