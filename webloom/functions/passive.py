"""Passive findings in bodies, as regular expressions in column expressions.

Word boundaries are those of ASCII, as in RE2: \\b of java.util.regex takes
letters such as é for word characters and would miss matches beside them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMAIL, BUCKET, API, SOCIAL, SECRET, INTERNAL = "email", "bucket", "api-endpoint", "social", "secret-like", "internal-host"
FINDING = "array<struct<kind:string, value:string, evidence:string>>"
B = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"

# The patterns of findings (\b stands for an ASCII word boundary), and how many raw matches count.
EMAIL_PATTERN, EMAIL_CAP = r"(?i)\b[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,24}\b", 200
BUCKET_CAP = 100
BUCKET_PATTERNS = (
    r"(?i)(?://|\s)([a-z0-9][a-z0-9.\-]{1,61}[a-z0-9])\.s3[.\-](?:[a-z0-9\-]+\.)?amazonaws\.com\b",
    r"(?i)//s3[.\-](?:[a-z0-9\-]+\.)?amazonaws\.com/([a-z0-9][a-z0-9.\-]{1,61}[a-z0-9])\b",
    r"(?i)//(?:storage\.googleapis\.com/|storage\.cloud\.google\.com/)([a-z0-9][a-z0-9._\-]{1,61}[a-z0-9])\b",
    r"(?i)\b([a-z0-9]{3,24})\.blob\.core\.windows\.net\b",
    r"(?i)\b([a-z0-9][a-z0-9\-]{1,61})\.(?:[a-z0-9\-]+\.)?digitaloceanspaces\.com\b",
)
SOCIAL_CAP = 100
SOCIAL_PATTERN = r"(?i)https?://(?:www\.)?(?:twitter\.com|x\.com|linkedin\.com|github\.com|facebook\.com|instagram\.com|youtube\.com|t\.me|discord\.gg|medium\.com|stackoverflow\.com)/[A-Za-z0-9_\-./@]{1,80}"
SECRET_CAP = 20
SECRET_PATTERNS = (
    r"\bAKIA[0-9A-Z]{16}\b",
    r"\bASIA[0-9A-Z]{16}\b",
    r"\bAIza[0-9A-Za-z_\-]{35}\b",
    r"\bgh[pousr]_[A-Za-z0-9]{36,}\b",
    r"\bxox[baprs]-[A-Za-z0-9\-]{10,}\b",
    r"\bsk_live_[0-9a-zA-Z]{24,}\b",
    r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
)
PRIVATE_IP_PATTERN, PRIVATE_IP_CAP = r"\b(?:10\.\d{1,3}\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3}|172\.(?:1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3})\b", 50
HOSTNAME_PATTERN, HOSTNAME_CAP = r"(?i)\b((?:[a-z0-9](?:[a-z0-9\-]{0,61}[a-z0-9])?\.)+[a-z][a-z0-9\-]{1,23})\b", 2000
API_PATTERN, API_CAP = r"""(?i)["'`](/(?:api|rest|graphql|v[0-9]{1,2}|_next/data|wp-json|admin/api)(?:/[a-z0-9_\-./{}:]*)?)["'`]""", 120
PLACEHOLDER_EMAILS = ("example@example.com", "you@example.com", "user@example.com", "name@email.com", "email@example.com", "someone@example.com")
INTERNAL_TLDS = ("internal", "intranet", "corp", "local", "localdomain", "lan", "test")
FILE_EXTENSIONS = ("js", "mjs", "ts", "css", "json", "html", "htm", "xml", "map", "png", "jpg", "svg", "gif", "txt", "md", "php", "py", "go")
ENVIRONMENT_LABELS = ("staging", "stage", "dev", "uat", "qa", "test", "preprod", "internal", "intranet")

# Strings without which a pattern of the same place can't match, in lower case.
BUCKET_NEEDS = ("amazonaws.com", "amazonaws.com", "//storage.", ".blob.core.windows.net", "digitaloceanspaces.com")
SECRET_NEEDS = ("akia", "asia", "aiza", "gh", "xox", "sk_live_", "private key-----")


#: A boundary before what begins with a letter or digit, which needs no look ahead.
_BEFORE_WORD = re.compile(r"\\b(?=(?:\((?:\?:)?)*(?:[0-9A-Za-z]|\[a-z0-9\]))")


def java_pattern(pattern: str) -> str:
    """The pattern with ASCII word boundaries; what goes before an @ can't hold one, so it is never given back."""
    pattern = _BEFORE_WORD.sub(lambda m: r"(?<![0-9A-Za-z_])", pattern)
    return pattern.replace(r"\b", B).replace("]+@", "]++@")


def _all(text: Column, pattern: str, cap: int, group: int = 0, needs: str | tuple[str, ...] = ()) -> Column:
    """The first matches of a pattern; the expression runs only on texts that hold one of the (lower-case) strings it needs."""
    found = F.slice(F.regexp_extract_all(text, F.lit(java_pattern(pattern)), F.lit(group)), 1, cap)
    if not needs:
        return found
    held = F.lit(False)
    for need in (needs,) if isinstance(needs, str) else needs:
        held = held | F.contains(F.lower(text), F.lit(need))
    return F.when(held, found).otherwise(F.array().cast("array<string>"))


def _found(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"), F.lit("").alias("evidence")))


def is_internal_host(host: Column) -> Column:
    """A name of a private suffix, or with an environment label and two labels or more after it."""
    labels = F.split(F.lower(host), r"\.")
    n = F.size(labels)
    last = F.element_at(labels, -1)
    before = F.slice(labels, F.lit(1), F.greatest(n - 2, F.lit(0)))
    return (n >= 2) & ~last.isin(*FILE_EXTENSIONS) & (last.isin(*INTERNAL_TLDS) | F.exists(before, lambda x: x.isin(*ENVIRONMENT_LABELS)))


def emails(text: Column) -> Column:
    lower = lambda e: F.lower(e)
    return F.filter(_all(text, EMAIL_PATTERN, EMAIL_CAP, needs="@"), lambda e: ~lower(e).isin(*PLACEHOLDER_EMAILS) & ~lower(e).endswith(".png") & ~lower(e).endswith(".jpg"))


def buckets(text: Column) -> Column:
    """Names of buckets, with the whole match as evidence."""

    def one(pattern: str, need: str) -> Column:
        name = lambda m: F.regexp_extract(m, java_pattern(pattern), 1)
        return F.transform(_all(text, pattern, BUCKET_CAP, 0, need), lambda m: F.struct(F.lit(BUCKET).alias("kind"), name(m).alias("value"), m.alias("evidence")))

    return F.concat(*[one(p, n) for p, n in zip(BUCKET_PATTERNS, BUCKET_NEEDS, strict=True)])


def socials(text: Column) -> Column:
    return F.transform(_all(text, SOCIAL_PATTERN, SOCIAL_CAP, needs="://"), lambda v: F.regexp_replace(v, r"[/.]+$", ""))


def secrets(text: Column) -> Column:
    return F.concat(*[_all(text, p, SECRET_CAP, needs=n) for p, n in zip(SECRET_PATTERNS, SECRET_NEEDS, strict=True)])


def private_ips(text: Column) -> Column:
    return _all(text, PRIVATE_IP_PATTERN, PRIVATE_IP_CAP, needs=("10.", "192.168.", "172."))


def internal_hosts(text: Column) -> Column:
    return F.transform(F.filter(_all(text, HOSTNAME_PATTERN, HOSTNAME_CAP, 1, tuple(f".{t}" for t in INTERNAL_TLDS) + tuple(f"{e}." for e in ENVIRONMENT_LABELS)), is_internal_host), F.lower)


def api_paths(text: Column) -> Column:
    return _all(text, API_PATTERN, API_CAP, 1, ("/api", "/rest", "/graphql", "/v", "/_next", "/wp-json", "/admin"))


def findings(text: Column, apis: Column | None = None) -> Column:
    """All findings of a text in FINDING: distinct by kind and lower-cased value, the first spelling kept, sorted.

    apis, if given, are the API findings of a script; else quoted paths count.
    A null text has none.
    """
    t = F.coalesce(text, F.lit(""))
    everything = F.concat(
        _found(EMAIL, emails(t)), buckets(t), _found(SOCIAL, socials(t)), _found(SECRET, secrets(t)), _found(INTERNAL, private_ips(t)),
        _found(INTERNAL, internal_hosts(t)), _found(API, api_paths(t)) if apis is None else apis,
    )
    return distinct_findings(everything)


def distinct_findings(found: Column) -> Column:
    """The first of each kind and lower-cased value, in the order of kind and value."""
    # found is named once: an expression inside a lambda is computed again for each element
    keyed = F.transform(found, lambda f, i: F.struct(f["kind"].alias("kind"), F.lower(f["value"]).alias("key"), i.alias("at"), f["value"].alias("value"), f["evidence"].alias("evidence")))
    last = lambda held: F.get(held, F.size(held) - 1)
    repeat = lambda held, f: (last(held)["kind"].eqNullSafe(f["kind"])) & (last(held)["key"].eqNullSafe(f["key"]))
    none = F.array().cast("array<struct<kind:string, key:string, at:int, value:string, evidence:string>>")
    first = F.aggregate(F.array_sort(keyed), none, lambda held, f: F.when(repeat(held, f) | (f["value"] == ""), held).otherwise(F.array_append(held, f)))
    return F.array_sort(F.transform(first, lambda f: F.struct(f["kind"].alias("kind"), f["value"].alias("value"), f["evidence"].alias("evidence"))))


def css_findings(body: Column) -> Column:
    """Findings of a stylesheet without its comments."""
    return findings(F.regexp_replace(body, r"(?s)/\*.*?\*/", ""))


def comment_findings(comments: Column) -> Column:
    return findings(F.array_join(comments, "\n"))


def redacted(found: DataFrame, value_col: str = "value", kind_col: str = "kind") -> DataFrame:
    """Findings with secrets cut to their first four characters, for exports."""
    short = F.concat(F.substring(value_col, 1, 4), F.lit("..."))
    return found.withColumn(value_col, F.when(F.col(kind_col) == SECRET, short).otherwise(F.col(value_col)))
