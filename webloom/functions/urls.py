"""URL identity as column expressions: canonical form, reference resolution, host tests.

Everything here is evaluated in the JVM. Invalid input gives null; canon_error()
says why.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that identify a visitor or a campaign, not a resource.
TRACKING_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id",
    "gclid", "fbclid", "msclkid", "dclid", "yclid", "igshid", "mc_cid", "mc_eid",
    "_ga", "_gl", "ref_src", "ref_url", "sessionid", "session_id",
    "phpsessid", "jsessionid", "aspsessionid", "cfid", "cftoken",
)
# References with these prefixes lead to no page.
NOT_NAVIGABLE = ("javascript:", "mailto:", "tel:", "data:", "about:", "blob:", "sms:", "ftp:", "file:")

SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
SPACE = " \t\r\n\u000b\u000c"


@dataclass(frozen=True)
class CanonOptions:
    strip_params: tuple[str, ...] = TRACKING_PARAMS
    keep_query: bool = True
    sort_query: bool = True


def _trim(c: Column) -> Column:
    return F.trim(c, F.lit(SPACE))


def _no_fragment(c: Column) -> Column:
    return F.regexp_extract(c, r"(?s)^([^#]*)", 1)


def filter_query(query: Column, options: CanonOptions = CanonOptions()) -> Column:
    """Drop empty and tracking parameters, sort the rest bytewise; values are never decoded."""
    kept = F.filter(F.split(query, "&"), lambda kv: (kv != "") & ~F.lower(F.regexp_extract(kv, r"(?s)^([^=]*)", 1)).isin(*options.strip_params))
    return F.array_join(F.array_sort(kept) if options.sort_query else kept, "&")


def escaped_path(path: Column) -> Column:
    """The path with every byte outside the safe set percent-encoded; a path that is valid stays as it is."""
    valid = path.rlike(r"^(?:[A-Za-z0-9\-_.~!$&'()*+,;=:@\[\]/]|%[0-9A-Fa-f]{2})*$")
    again = F.url_encode(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))))
    # what form encoding escapes and a path does not, and the reverse
    for encoded, plain in (("+", "%20"), ("*", "%2A"), ("%24", "$"), ("%26", "&"), ("%2B", "+"), ("%2C", ","), ("%2F", "/"), ("%3A", ":"), ("%3B", ";"), ("%3D", "="), ("%40", "@"), ("%7E", "~")):
        again = F.replace(again, F.lit(encoded), F.lit(plain))
    return F.when(valid, path).otherwise(again)


def clean_path(path: Column) -> Column:
    """Resolve . and .. segments and collapse slashes, keeping a trailing slash."""
    stack = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s.isin("", "."), acc)
        .when(s == "..", F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc))
        .otherwise(F.array_append(acc, s)),
    )
    joined = F.concat(F.lit("/"), F.array_join(stack, "/"))
    return F.when(path.endswith("/") & (joined != "/"), F.concat(joined, F.lit("/"))).otherwise(joined)


def _parts(raw: Column) -> dict[str, Column]:
    url = _no_fragment(_trim(raw))
    rest = F.regexp_extract(url, r"(?s)^[A-Za-z][A-Za-z0-9+.\-]*:(.*)$", 1)
    authority = F.regexp_extract(rest, r"(?s)^//([^/?]*)", 1)
    hostport = F.regexp_extract(authority, r"(?s)([^@]*)$", 1)
    return {
        "url": url,
        "scheme": F.lower(F.regexp_extract(url, SCHEME, 1)),
        "host": F.regexp_replace(F.lower(F.regexp_extract(hostport, r"(?s)^(\[[^\]]*\]|[^:]*)", 1)), r"\.$", ""),
        "port": F.regexp_extract(hostport, r"(?s)^(?:\[[^\]]*\]|[^:]*)(.*)$", 1),
        "path": F.regexp_extract(rest, r"(?s)^(?://[^/?]*)?([^?]*)", 1),
        "query": F.regexp_extract(rest, r"(?s)\?(.*)$", 1),
    }


def canon_error(raw: Column) -> Column:
    """Null for URLs that canonical_url() accepts; else `no host`, `not http` or `malformed`."""
    p = _parts(raw)
    return (
        F.when(raw.isNull() | (_trim(raw) == ""), F.lit("no host"))
        .when(p["url"].rlike(r"[\x00-\x1f\x7f]"), F.lit("malformed"))
        .when(~p["scheme"].isin("http", "https"), F.lit("not http"))
        .when(p["path"].rlike(r"%(?![0-9A-Fa-f]{2})") | p["host"].rlike(r"[ <>\"%]") | ~p["port"].rlike(r"^(?::[0-9]*)?$"), F.lit("malformed"))
        .when(p["host"] == "", F.lit("no host"))
    )


def canonical_url(raw: Column, options: CanonOptions = CanonOptions()) -> Column:
    """An absolute http(s) URL's identity, or null: lower-case scheme and host, no default port,
    user or fragment, dot segments resolved, tracking parameters dropped and the others sorted."""
    p = _parts(raw)
    port = F.substring(p["port"], 2, 10)
    default = ((p["scheme"] == "http") & (port == "80")) | ((p["scheme"] == "https") & (port == "443")) | (port == "")
    query = filter_query(p["query"], options) if options.keep_query else F.lit("")
    url = F.concat(
        p["scheme"], F.lit("://"), p["host"], F.when(default, "").otherwise(F.concat(F.lit(":"), port)),
        clean_path(escaped_path(p["path"])), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    )
    return F.when(canon_error(raw).isNull(), url)


def resolve_url(base: Column, ref: Column, options: CanonOptions = CanonOptions()) -> Column:
    """The canonical URL that a reference on a page leads to, or null for none."""
    r = _trim(ref)
    lower = F.lower(r)
    dead = (r == "") | r.startswith("#")
    for prefix in NOT_NAVIGABLE:
        dead = dead | lower.startswith(prefix)
    b = _no_fragment(_trim(base))
    scheme = F.regexp_extract(b, SCHEME, 1)
    root = F.regexp_extract(b, r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*://[^/?]*)", 1)
    page = F.regexp_extract(b, r"(?s)^([^?]*)", 1)
    path = F.substring(page, F.length(root) + 1, F.length(page))
    folder = F.concat(root, F.coalesce(F.nullif(F.regexp_extract(path, r"(?s)^(.*/)", 1), F.lit("")), F.lit("/")))
    absolute = (
        F.when(r.rlike(SCHEME), r)
        .when(r.rlike(r"^[^/?#]*:"), F.lit(None))
        .when(r.startswith("//"), F.concat(scheme, F.lit(":"), r))
        .when(r.startswith("/"), F.concat(root, r))
        .when(r.startswith("?"), F.concat(F.when(path == "", F.concat(page, F.lit("/"))).otherwise(page), r))
        .otherwise(F.concat(folder, r))
    )
    return F.when(~dead, canonical_url(absolute, options))


def url_scheme(canon: Column) -> Column:
    return F.regexp_extract(canon, r"^([^:]*)://", 1)


def url_host(canon: Column) -> Column:
    """Host of a canonical URL, with its port if it is no default one."""
    return F.regexp_extract(canon, r"://([^/?]*)", 1)


def url_path(canon: Column) -> Column:
    """Path of a canonical URL, without the query."""
    return F.regexp_extract(canon, r"://[^/?]*([^?]*)", 1)


def hostname(host: Column) -> Column:
    """Lower-case host without port and trailing dot."""
    return F.regexp_replace(F.regexp_replace(F.lower(host), r":[0-9]*$", ""), r"\.$", "")


def root_domain(host: Column) -> Column:
    """The last two labels of a host; suffixes of several labels are not known."""
    labels = F.split(hostname(host), r"\.")
    return F.when(F.size(labels) > 2, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(hostname(host))


def same_or_subdomain(host: Column, target: Column) -> Column:
    h, t = hostname(host), hostname(target)
    return (h == t) | h.endswith(F.concat(F.lit("."), t))


def canonical_list(urls: Column, options: CanonOptions = CanonOptions()) -> Column:
    """Canonical forms of an array of URLs, in order, invalid ones left out."""
    return F.filter(F.transform(urls, lambda u: canonical_url(u, options)), lambda u: u.isNotNull())


def is_js_path(path: Column) -> Column:
    return path.endswith(".js") & (F.length(path) > 3)
