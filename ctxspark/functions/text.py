"""Strings: tokens, names, classification, redaction, markup.

Word boundaries are ASCII on purpose: the patterns come from a dialect in which accented letters are no word
characters, so \\b is spelled as a pair of look-arounds."""

from __future__ import annotations

import re
import string
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII word boundaries before and after a word.
LEFT, RIGHT = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"

#: Entity types by ordered keyword lists.
TYPE_WORDS = (
    ("security_fix", "security|cve|vuln|vulnerab|exploit|xss|csrf|injection|sanitize"),
    ("breaking_change", "breaking|breaking-change|deprecat|major|migrat|remove|removed|rename|renamed|incompatib"),
    ("bug_fix", "fix|fixes|fixed|bug|bugfix|hotfix|patch|correct|resolve|resolves"),
    ("tech_debt", "todo|hack|workaround|debt|temporary|temp|quick fix|kludge|refactor later"),
    ("decision", "decision|decide|choose|chose|standardize|standard|adopt|adopted|rationale|why"),
    ("pattern", "pattern|refactor|extract|introduce|implement|add|feat|feature|new"),
    ("workflow", "workflow|ci|cd|pipeline|release|deploy|process|automation"),
    ("concept", "concept|domain|model|entity|notion|idea|design"),
)
#: Conventional commit prefixes.
COMMIT_TYPES = ("feat", "fix", "refactor", "docs", "chore", "perf", "security", "test", "build", "ci", "style", "revert")
#: Tags by keyword; old- matches after _ becomes -, as meant.
TAGS = {
    "domain": (("Payment", ("invoice", "billing", "payment", "transaction", "credit-card")), ("User", ("user", "account", "profile", "auth", "session")), ("Order", ("order", "cart", "shipping", "inventory", "sku"))),
    "region": (("US-East", ("us-east", "virginia", "ashburn")), ("EU-West", ("eu-west", "ireland", "dublin"))),
    "system": (("Legacy", ("legacy", "mainframe", "v1", "old-")), ("Cloud", ("cloud", "aws", "azure", "gcp", "k8s"))),
}
#: Secrets by pattern, in order.
SECRETS = (
    ("api_key", rf"(?i){LEFT}(?:api[_-]?key|apikey|secret|token|password|passwd|pwd)\s*[:=]\s*['\"]?[A-Za-z0-9_\-.]{{8,}}['\"]?"),
    ("aws_key", rf"{LEFT}(?:AKIA|ASIA)[A-Z0-9]{{16}}{RIGHT}"),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("connection_string", rf"(?i){LEFT}(?:postgres|mysql|mongodb|redis|amqp)://[^\s'\"]+"),
    ("jwt", rf"{LEFT}eyJ[A-Za-z0-9_-]{{10,}}\.[A-Za-z0-9_-]{{10,}}\.[A-Za-z0-9_-]{{10,}}{RIGHT}"),
)
#: Workflow states of trackers.
STATUSES = (
    ("implemented", "done|closed|resolved|completed?|released|fixed"),
    ("approved", "in progress|in review|in development|in qa|review|approved|ready"),
    ("draft", "to do|todo|open|backlog|new|triage|draft"),
)
#: References to tables in SQL and in mappings.
SQL_TABLES = (r"FROM\s+([\w.]+)", r"JOIN\s+([\w.]+)", r"INTO\s+([\w.]+)", r"UPDATE\s+([\w.]+)", r"TABLE\s+(?:IF\s+(?:NOT\s+)?EXISTS\s+)?([\w.]+)")
ORM_TABLES = (r"@Table\s*\(\s*name\s*=\s*[\"']([\w.]+)[\"']\s*\)", r"@Entity\s*\(\s*name\s*=\s*[\"']([\w.]+)[\"']\s*\)", r"db\.collection\s*\(\s*[\"']([\w.]+)[\"']\s*\)", r"db\.getCollection\s*\(\s*[\"']([\w.]+)[\"']\s*\)")


def trim(x: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def tokenize(x: Column) -> Column:
    """Distinct lower-case tokens [a-z0-9_] of two characters or more, in order of first appearance."""
    return F.array_distinct(all_tokens(x))


def all_tokens(x: Column) -> Column:
    return F.filter(F.split(F.lower(x), r"[^a-z0-9_]+"), lambda t: F.length(t) > 1)


def seed_variants(tokens: Column) -> Column:
    """Each token and, for plurals of over three letters, the token without its s."""

    def both(t: Column) -> Column:
        plural = (F.length(t) > 3) & t.endswith("s") & ~t.endswith("ss")
        return F.when(plural, F.array(t, t.substr(F.lit(1), F.length(t) - 1))).otherwise(F.array(t))

    return F.array_distinct(F.flatten(F.transform(tokens, both)))


def first_line(x: Column, most: int = 160) -> Column:
    """The first line that isn't blank, trimmed, with an ellipsis if longer than most."""
    line = F.coalesce(F.get(F.filter(F.transform(F.split(x, "\n"), trim), lambda t: t != ""), F.lit(0)), F.lit(""))
    return clamp_text(line, most, "…")


def clamp_text(x: Column, most: int, mark: str = "...") -> Column:
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most - len(mark)), F.lit(mark))).otherwise(x)


def classify_type(x: Column) -> Column:
    """The first entity type one of whose words occurs. The text is cut into words once; a pattern is tried only for a phrase
    whose first word occurs."""
    low = F.translate(x, string.ascii_uppercase, string.ascii_lowercase)
    kinds = [(name, words.split("|")) for name, words in TYPE_WORDS]
    known = sorted({re.match(r"\w+", w)[0] for _, words in kinds for w in words})

    def first(found: Column) -> Column:
        rule = F
        for name, words in kinds:
            hit = F.arrays_overlap(found, F.array(*[F.lit(w) for w in words if w.isidentifier()]))
            for w in words:
                if not w.isidentifier():
                    hit = hit | (F.array_contains(found, re.match(r"\w+", w)[0]) & low.rlike(f"{LEFT}{w}{RIGHT}"))
            rule = rule.when(hit, name)
        return rule.otherwise("concept")

    return F.transform(F.array(F.filter(F.split(low, "[^a-z0-9_]+"), lambda t: t.isin(*known))), first)[0]


def derive_name(message: Column) -> Column:
    """A kebab-case name without the conventional prefix."""
    x = F.regexp_replace(message, rf"^(?i)(?:{'|'.join(COMMIT_TYPES)})(?:\([^)]*\))?:\s*", "")
    x = F.lower(F.regexp_replace(F.regexp_replace(x, r"[^A-Za-z0-9]+", "-"), r"^-+|-+$", ""))
    return F.when(x == "", "untitled").otherwise(x)


def commit_type(message: Column) -> Column:
    x = F.lower(F.regexp_extract(message, r"^([A-Za-z]+)(?:\([^)]*\))?:", 1))
    return F.when(x.isin(*COMMIT_TYPES), x).otherwise("other")


def uuid5(x: Column) -> Column:
    """SHA-1 of the string in the shape of a version-5 UUID."""
    h = F.sha1(x)

    def part(a: int, n: int) -> Column:
        return F.substring(h, a, n)

    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def entity_id(kind: Column, name: Column) -> Column:
    return uuid5(F.concat(F.lit("type:"), kind, F.lit(":"), name))


def entity_content(message: Column, files: Column) -> Column:
    return F.concat(message, F.lit(" — files: "), F.when(F.size(files) > 0, F.array_join(files, ", ")).otherwise("none"))


def tag(name: Column, dimension: str) -> Column:
    """The first tag of a dimension (domain, region, system) one of whose keywords the name contains; else null."""
    x = F.translate(F.lower(name), "_", "-")
    rule = None
    for value, words in TAGS[dimension]:
        hit = reduce(lambda a, b: a | b, [x.contains(w) for w in words])
        rule = F.when(hit, value) if rule is None else rule.when(hit, value)
    return rule


def service_name(path: Column) -> Column:
    """The base name, up to its first dot, of a file called ...Service, ...Controller or ...Repository; else null."""
    hit = path.rlike(r"(?i)(?:Service|Controller|Repository)[^/]*\.[^/]*$")
    return F.when(hit, F.substring_index(F.substring_index(path, "/", -1), ".", 1))


def storage_system(path: Column) -> Column:
    p = F.coalesce(path, F.lit(""))
    return F.when(p.contains("mongo"), "mongodb").when(p.contains("Service") | p.contains("Repository") | p.contains("sql"), "sql").otherwise("unknown")


def external_status(x: Column) -> Column:
    """A tracker's state as draft, approved or implemented; draft if unknown."""
    v = trim(F.coalesce(x, F.lit("")))
    rule = None
    for status, words in STATUSES:
        hit = v.rlike(rf"^(?i)(?:{words})$")
        rule = F.when(hit, status) if rule is None else rule.when(hit, status)
    return rule.otherwise("draft")


def known_status(x: Column) -> Column:
    return trim(F.coalesce(x, F.lit(""))).rlike(rf"^(?i)(?:{'|'.join(w for _, w in STATUSES)})$")


def html_to_text(x: Column) -> Column:
    """Tracker HTML as text: breaks and blocks end lines, list items get a dash, tags go before references are decoded."""
    x = F.coalesce(x, F.lit(""))
    for pattern, to in ((r"(?i)<\s*br\s*/?\s*>", "\n"), (r"(?i)<\s*li[^>]*>", "- "), (r"(?i)<\s*/\s*(?:p|div|li|ul|ol|h[1-6]|tr|table)\s*>", "\n"), (r"<[^>]+>", "")):
        x = F.regexp_replace(x, pattern, to)
    for name, to in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(to))
    return trim(F.regexp_replace(F.regexp_replace(x, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))


def atomic_statements(x: Column) -> Column:
    """The lines of a text as array of (pos, text, type): bullet, modal (shall, must, should, will) or general."""
    lines = F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), "\n"), trim), lambda t: t != "")

    def statement(t: Column, i: Column) -> Column:
        bullet = t.rlike(r"^[•*-]\s+")
        modal = t.rlike(rf"(?i){LEFT}(?:shall|must|should|will){RIGHT}")
        return F.struct(i.cast("long").alias("pos"), F.when(bullet, F.regexp_replace(t, r"^[•*-]\s+", "")).otherwise(t).alias("text"), F.when(bullet, "bullet").when(modal, "modal").otherwise("general").alias("type"))

    return F.transform(lines, statement)


def strip_comments(x: Column) -> Column:
    for pattern in (r"(?s)/\*.*?\*/", r"//[^\n]*", r"--[^\n]*", r"#[^\n]*"):
        x = F.regexp_replace(x, pattern, " ")
    return x


def sql_tables(x: Column) -> Column:
    """Sorted distinct tables that a text of SQL or code refers to, outside comments."""
    bare = strip_comments(x)
    found = [F.regexp_extract_all(bare, F.lit(rf"(?i){LEFT}{p}"), F.lit(1)) for p in SQL_TABLES]
    found += [F.regexp_extract_all(bare, F.lit(f"(?i){p}"), F.lit(1)) for p in ORM_TABLES]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def config_tables(x: Column) -> Column:
    """Tables that XML and YAML mappings name."""
    return F.array_distinct(F.concat(F.regexp_extract_all(x, F.lit(rf"{LEFT}table\s*=\s*[\"']([\w.]+)[\"']"), F.lit(1)), F.regexp_extract_all(x, F.lit(r"(?m)^[ \t]*table:[ \t]*([\w.-]+)"), F.lit(1))))


def requirement_marks(x: Column) -> Column:
    """(line from 1, requirement id) of each @req annotation."""
    lines = F.transform(F.split(x, "\n"), lambda t, i: F.transform(F.regexp_extract_all(t, F.lit(r"@req\s+([\w-]+)"), F.lit(1)), lambda r: F.struct((i + 1).alias("line"), r.alias("req_id"))))
    return F.flatten(lines)


def redact_patterns(x: Column) -> Column:
    for label, pattern in SECRETS:
        x = F.regexp_replace(x, pattern, f"[REDACTED:{label}]")
    return x


def shannon_entropy(x: Column) -> Column:
    """Bits a character; a character's count is what its removal takes off the length."""
    n = F.length(x)

    def part(c: Column) -> Column:
        p = (n - F.length(F.replace(x, c, F.lit("")))) / n
        return -p * F.log2(p)

    return F.when(n > 0, F.aggregate(F.array_distinct(F.split(x, "")), F.lit(0.0), lambda a, c: a + F.when(c == "", 0.0).otherwise(part(c)))).otherwise(0.0)


def complexity(x: Column) -> Column:
    """One more than the branches."""
    words = F.regexp_count(x, F.lit(rf"{LEFT}(?:if|for|while|switch){RIGHT}"))
    return (1 + words + F.regexp_count(x, F.lit(r"&&|\|\||\?"))).cast("long")


def strip_fences(x: Column) -> Column:
    return trim(F.regexp_replace(F.regexp_replace(trim(x), r"^```[a-zA-Z]*\s*\n?", ""), r"\n?```$", ""))


def week(ts: Column) -> Column:
    """Year and week of the year from Monday, days before the first Monday being week 00."""
    n = F.floor((F.dayofyear(ts) - 1 + 7 - F.weekday(ts)) / 7)
    return F.concat(F.date_format(ts, "yyyy"), F.lit("-"), F.lpad(n.cast("string"), 2, "0"))


def clamp01(x: Column) -> Column:
    """Between 0 and 1; null stays null, which greatest and least would skip."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def time_ago(ts: Column, now: Column) -> Column:
    s = F.unix_timestamp(now) - F.unix_timestamp(ts)

    def unit(n: int, mark: str) -> Column:
        return F.concat(F.floor(s / n).cast("string"), F.lit(mark))

    return F.when(s < 60, unit(1, "s ago")).when(s < 3600, unit(60, "m ago")).when(s < 86400, unit(3600, "h ago")).when(s < 30 * 86400, unit(86400, "d ago")).otherwise(F.date_format(ts, "yyyy-MM-dd"))
