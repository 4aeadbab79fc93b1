"""Scope rules: which URLs a crawl follows, records or rejects."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions.urls import hostname, url_host, url_path, url_scheme

CRAWL, RECORD, REJECT = "crawl", "record", "reject"


def check_patterns(patterns: tuple[str, ...]) -> None:
    """Raise ValueError that names the first pattern that is no regular expression."""
    for pattern in patterns:
        try:
            re.compile(pattern)
        except re.error as e:
            raise ValueError(f"bad pattern {pattern!r}: {e}") from None


@dataclass(frozen=True)
class ScopeRules:
    """max_depth below 0 is no limit. Patterns are searched for in the canonical URL."""

    seed_hosts: tuple[str, ...] = ()
    allow_subdomains: bool = False
    max_depth: int = 3
    record_external: bool = True
    schemes: tuple[str, ...] = ("http", "https")
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    path_prefix: str = ""

    def __post_init__(self) -> None:
        check_patterns(self.include + self.exclude)

    def with_seed_host(self, host: str) -> ScopeRules:
        host = re.sub(r"(:\d*)?$", "", host.lower()).removesuffix(".")
        return self if not host or host in self.seed_hosts else replace(self, seed_hosts=(*self.seed_hosts, host))

    def in_scope_host(self, host: Column) -> Column:
        """A seed host, or one below it where subdomains are allowed."""
        h = hostname(host)
        if not self.seed_hosts:
            return F.lit(False)
        same = h.isin(*self.seed_hosts)
        for seed in self.seed_hosts if self.allow_subdomains else ():
            same = same | h.endswith("." + seed)
        return same

    def decide(self, url: Column, depth: Column) -> Column:
        """crawl, record or reject for canonical URLs found at a depth."""
        scheme, host = F.lower(url_scheme(url)), url_host(url)
        outside = F.lit(RECORD if self.record_external else REJECT)
        found = lambda patterns: F.lit(False) if not patterns else url.rlike("|".join(f"(?:{p})" for p in patterns))
        decision = F.when(url.isNull() | (host == "") | ~scheme.isin(*self.schemes), F.lit(REJECT)).when(found(self.exclude), F.lit(REJECT)).when(~self.in_scope_host(host), outside)
        if self.include:
            decision = decision.when(~found(self.include), F.lit(RECORD))
        if self.path_prefix:
            decision = decision.when(~path_has_prefix(F.try_url_decode(F.replace(url_path(url), F.lit("+"), F.lit("%2B"))), self.path_prefix), F.lit(RECORD))
        if self.max_depth >= 0:
            decision = decision.when(depth > self.max_depth, F.lit(RECORD))
        return decision.otherwise(F.lit(CRAWL))


def path_has_prefix(path: Column, prefix: str) -> Column:
    """Prefix at a segment boundary; slashes at the ends don't count."""
    wanted = prefix.strip("/")
    own = F.trim(path, F.lit("/"))
    return F.lit(True) if not wanted else (own == wanted) | own.startswith(wanted + "/")
