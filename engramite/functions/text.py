"""Text functions as columns. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Distinct lower-case ASCII tokens."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: x != ""))


def words(text: Column) -> Column:
    """Lower-case words between white space, as a set; an empty string counts as a word."""
    return F.array_distinct(F.split(F.lower(text), r"\s+"))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two texts' word sets; 0 if either is null or empty."""
    x, y = words(a), words(b)
    both = F.size(F.array_intersect(x, y))
    return F.when(a.isNull() | b.isNull() | (a == "") | (b == ""), F.lit(0.0)).otherwise(both / (F.size(x) + F.size(y) - both))


def bare_words(text: Column) -> Column:
    """Word sets without punctuation, for the relationship of two texts."""
    return F.array_distinct(F.filter(F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.regexp_replace(w, r"[.,/#!$%^&*;:{}=\-_`~()]", "")), lambda w: w != ""))


def relationship(a: Column, b: Column) -> Column:
    """duplicate, contradiction, subset:a, subset:b (the one to keep) or different."""
    x, y = bare_words(a), bare_words(b)
    return relationship_of_sizes(F.size(x), F.size(y), F.size(F.array_intersect(x, y)))


def relationship_of_sizes(na: Column, nb: Column, both: Column) -> Column:
    distance = 1 - both / (na + nb - both)
    return (
        F.when((na == 0) | (nb == 0) | (distance == 0), "duplicate")
        .when((distance > 0.15) & (distance < 0.65), "contradiction")
        .when((both / na > 0.85) & (nb > na), "subset:b")
        .when((both / nb > 0.85) & (na > nb), "subset:a")
        .when(distance < 0.25, "duplicate")
        .otherwise("different")
    )


# Words that decide the intent and the urgency of a query, the first family that occurs wins.
INTENTS = {
    "database_management": "db|database|sqlite|sql|table|migration|schema",
    "deployment": "deploy|ci|cd|vercel|publish|release|prod|staging",
    "ui_styling": "style|css|html|theme|design|layout|align|color|font",
    "testing": "test|spec|unit|mock|heavy|smoke",
    "debugging": "error|bug|fail|crash|break|exception|stack|trace|refused|debug",
}
URGENCIES = {
    "critical": "panic|emergency|broken|critical|urgent|fatal|security|leak|bypass|vulnerability",
    "high": "fail|error|crash|prevent|stop|warn|warning|issue|broken",
    "medium": "update|change|add|tweak|check|verify",
}


def _first_family(text: Column, families: dict[str, str], other: str) -> Column:
    low, out = F.lower(F.coalesce(text, F.lit(""))), F.lit(other)
    for name, pattern in reversed(families.items()):
        out = F.when(low.rlike(pattern), name).otherwise(out)
    return out


def intent(query: Column, given: Column | None = None) -> Column:
    found = _first_family(query, INTENTS, "general")
    return found if given is None else F.when(given.isNotNull() & (given != "general") & (given != ""), given).otherwise(found)


def urgency(query: Column) -> Column:
    return _first_family(query, URGENCIES, "low")


# Importance of a commit by the prefix of its subject.
COMMIT_PREFIXES = {"architectural": ("feat", "fix", "refactor", "breaking", "decision"), "chore": ("chore", "docs", "test", "style", "ci")}
COMMIT_IMPORTANCE = {"architectural": 0.9, "chore": 0.4, "other": 0.6}


def commit_class(subject: Column) -> Column:
    s, out = F.lower(F.trim(subject)), F.lit("other")
    for name, prefixes in COMMIT_PREFIXES.items():
        out = F.when(s.rlike(f"^(?:{'|'.join(prefixes)}):"), name).otherwise(out)
    return out


def commit_importance(subject: Column) -> Column:
    kind = commit_class(subject)
    return F.when(kind == "architectural", 0.9).when(kind == "chore", 0.4).otherwise(0.6)


def clean_fact(text: Column) -> Column:
    """Trimmed, white space collapsed, without closing , ; : and outer quotes, at most 200 characters."""
    x = F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+\z", ""), r"\s+", " ")
    x = F.regexp_replace(x, r"[,;:]+\z", "")
    return F.substring(F.regexp_replace(x, "^[\"'`]+|[\"'`]+\\z", ""), 1, 200)


def dedup_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def json_array_rescue(text: Column) -> Column:
    """The JSON array in a model's answer: without code fences, else from the first [ to the last ]."""
    bare = F.trim(F.regexp_replace(text, "```(?:json)?", ""))
    return F.when(bare.rlike(r"^\[(?s:.*)\]\z"), bare).otherwise(F.regexp_extract(bare, r"(?s)(\[.*\])", 1))


# What takes a secret's place, and the shape of credentials in an address.
REDACTED = "[REDACTED]"
URI_CREDENTIALS = r"(?i)([a-z0-9+.-]+://)([^/:\s]*):([^@/:\s]+)(@[^/\s]+)"
# Shapes of vendors' keys and tokens.
VENDOR_SHAPES = (
    r"\b(sk-[a-zA-Z0-9]{48})\b",
    r"\b(sk-proj-[a-zA-Z0-9-]{40,})\b",
    r"\b(gh[pous]_[a-zA-Z0-9]{36,255})\b",
    r"\b(xox[bapr]-[0-9]{12}-[a-zA-Z0-9]{24})\b",
    r"\b(AIzaSy[A-Za-z0-9_-]{33})\b",
    r"\b((?:sk|rk|pk)_(?:live|test)_[0-9a-zA-Z]{24,32})\b",
    r"(?i)\b(AKIA[0-9A-Z]{16,40})\b",
    r"(?i)\b(ASCA[0-9A-Z]{16,40})\b",
    r"\b(npm_[a-zA-Z0-9]{36,255})\b",
    r"\b(ey[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,})\b",
    r"(?i)-----BEGIN[A-Z0-9\s_-]+PRIVATE\s+KEY[A-Z0-9\s_-]*-----\s*[\s\S]*?-----END[A-Z0-9\s_-]+PRIVATE\s+KEY[A-Z0-9\s_-]*-----",
)


def redact_uri(text: Column) -> Column:
    """Passwords of connection strings; scheme, user and host stay."""
    return F.regexp_replace(text, URI_CREDENTIALS, "$1$2:[REDACTED]$4")


def redact_vendor(text: Column) -> Column:
    for shape in VENDOR_SHAPES:
        text = F.regexp_replace(text, shape, REDACTED)
    return text
