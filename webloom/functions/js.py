"""Endpoints in scripts: a small lexer and rules over its tokens, as Arrow-batched functions."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.runtime import ship_package

ENDPOINT = "array<struct<value:string, source:string, callee:string, dynamic:boolean>>"
TOKENS = "array<struct<stream:int, kind:string, value:string, dynamic:boolean, offset:int>>"

# Words after which a slash begins a regular expression, and what takes or holds a URL.
REGEX_AFTER = {"return", "typeof", "case", "do", "else", "in", "instanceof", "new", "delete", "void", "throw", "yield", "await", "of"}
RECEIVERS = {"axios", "$", "jQuery", "http", "$http", "api", "client", "ky", "superagent", "request", "httpClient", "instance"}
METHODS = {"get", "post", "put", "patch", "delete", "head", "options", "request", "getJSON", "ajax"}
CONSTRUCTORS = {"Request", "URL", "EventSource", "WebSocket"}
URL_KEYS = {"url", "href", "endpoint", "action", "src", "uri", "baseURL", "baseUrl", "apiUrl", "apiURL", "path"}
VERBS = {"GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS"}
GLOBALS = {"window", "globalThis", "self"}
API_LIKE = re.compile(r"(?i)^/(?:api|rest|graphql|v[0-9]{1,2}|_next/data|wp-json|admin/api)(?:/|$|\?)")
ABSOLUTE = re.compile(r"(?i)^https?://[a-z0-9.\-]+\.[a-z]{2,24}(?::\d{2,5})?(?:[/?#]|$)", re.ASCII)
RANK = {"call": 3, "property": 2, "literal": 1}
MAX_TERMS = 8

_SKIP = re.compile(r"(?:[^\x21-\x7e]|//[^\n]*|/\*.*?(?:\*/|\Z))+", re.S)
_IDENT = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*")
_NUMBER = re.compile(r"0[xX][0-9A-Za-z_]*|[0-9.](?:[eE][+-]|[0-9A-Za-z_.])*")
_REGEX = re.compile(r"/(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
_ESCAPE = re.compile(r"\\(?:x([0-9A-Fa-f]{2})|u([0-9A-Fa-f]{4})|u\{([0-9A-Fa-f]{1,6})\}|(\r\n|[\r\n\u2028\u2029])|(.))", re.S)
_SIMPLE = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}


@dataclass(frozen=True)
class Token:
    kind: str  # ident, punct, string, template, number, regex
    value: str
    dynamic: bool
    offset: int


def _decode(raw: str) -> str:
    def one(m: re.Match) -> str:
        digits = m[1] or m[2] or m[3]
        if digits:
            code = int(digits, 16)
            return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"
        return "" if m[4] else _SIMPLE.get(m[5], m[5])

    return _ESCAPE.sub(one, raw)


def lex(source: str) -> list[list[Token]]:
    """Token streams: the program's, and one for the code in each substitution of a template."""
    streams: list[list[Token]] = []
    # a stack of open streams and templates, so that nesting of any depth is no recursion
    _run(source, streams)
    return streams


def _run(source: str, streams: list[list[Token]]) -> None:
    out: list[Token] = []
    streams.append(out)
    # entries: the stream that goes on after the substitution, the template so far, its start, and open braces
    stack: list[list] = []
    i, n, depth = 0, len(source), 0
    while True:
        if skipped := _SKIP.match(source, i):
            i = skipped.end()
        if i >= n:
            while stack:  # a template that never ends is one up to here
                out, text, start, depth = stack.pop()
                out.append(Token("template", "".join(text), True, start))
            return
        c = source[i]
        if c == "`" or (c == "}" and stack and depth == 0):
            if c == "`":
                text, start, dynamic = [], i, False
            else:
                out, text, start, depth = stack.pop()
                dynamic = True
            i, opened = _template(source, i + 1, text)
            if opened:
                text.append("{}")
                stack.append([out, text, start, depth])
                out, depth = [], 0
                streams.append(out)
            else:
                out.append(Token("template", "".join(text), dynamic, start))
            continue
        if c in "\"'":
            end = re.compile(rf"(?:[^\\\n{c}]|\\.)*", re.S).match(source, i + 1).end()
            out.append(Token("string", _decode(source[i + 1 : end]), False, i))
            i = end + 1 if end < n and source[end] == c else end
            if i < n and end < n and source[end] == "\\":
                i = end + 1
            continue
        if m := _IDENT.match(source, i):
            kind = "ident"
        elif (c.isdigit() or (c == "." and source[i + 1 : i + 2].isdigit())) and (m := _NUMBER.match(source, i)):
            kind = "number"
        elif c == "/" and _regex_allowed(out) and (m := _REGEX.match(source, i)):
            kind = "regex"
        else:
            m, kind = None, "punct"
            depth += (c == "{") - (c == "}")
        value = m[0] if m else c
        out.append(Token(kind, value, False, i))
        i += len(value)


def _template(source: str, i: int, text: list[str]) -> tuple[int, bool]:
    """Read template text from i on; where it stopped, and whether a substitution begins there."""
    end = re.compile(r"(?:[^\\`$]|\\.|\$(?!\{))*", re.S).match(source, i).end()
    text.append(_decode(source[i:end]))
    if source.startswith("${", end):
        return end + 2, True
    return end + 1, False


def _regex_allowed(out: list[Token]) -> bool:
    if not out:
        return True
    last = out[-1]
    return last.value in REGEX_AFTER if last.kind == "ident" else last.kind == "punct" and last.value not in ")]"


def literals(source: str) -> str:
    """All string and template values, a line each."""
    return "\n".join(t.value for s in lex(source) for t in s if t.kind in ("string", "template"))


def plausible(v: str) -> bool:
    if not 2 <= len(v.encode()) <= 2048 or v.startswith("{}") or re.search(r"[\s<>\"'`\\^|]", v):
        return False
    if v.startswith("//"):
        return True
    return not re.search(r"[:*]", v) if v.startswith("/") else v.lower().startswith(("http://", "https://", "ws://", "wss://"))


def _static(t: Token) -> bool:
    return t.kind == "string" or (t.kind == "template" and not t.dynamic)


def _constants(streams: list[list[Token]]) -> dict[str, str]:
    """Names bound to one literal only."""
    found: dict[str, str | None] = {}
    for s in streams:
        for name, eq, value in zip(s, s[1:], s[2:]):
            if name.kind == "ident" and eq.value == "=" and eq.kind == "punct" and value.value not in ("=", ">"):
                text = value.value if _static(value) else None
                found[name.value] = text if found.get(name.value, text) == text else None
    return {k: v for k, v in found.items() if v is not None}


def _expression(s: list[Token], k: int, consts: dict[str, str]) -> tuple[str, bool] | None:
    """The text of `a + b + ...` from token k on, and whether part of it is only known at run time."""
    if k >= len(s) or (k and s[k - 1].kind == "punct" and s[k - 1].value == "+"):
        return None
    text, dynamic, known = "", False, False
    for _ in range(MAX_TERMS):
        if k >= len(s):
            break
        t = s[k]
        after = s[k + 1].value if k + 1 < len(s) and s[k + 1].kind == "punct" else ""
        if t.kind in ("string", "template"):
            text, dynamic, known = text + t.value, dynamic or t.dynamic, True
        elif t.kind == "ident" and t.value in consts and after not in (".", "(", "["):
            text, known = text + consts[t.value], True
        elif t.kind in ("ident", "number"):
            text, dynamic = text + "{}", True
        else:
            break
        k += 1
        level = 0
        while k < len(s) and not (level == 0 and s[k].kind == "punct" and s[k].value in "+,;)]}:?"):  # the rest of a term
            level += (s[k].value in "([{") - (s[k].value in ")]}") if s[k].kind == "punct" else 0
            k += 1
        if k >= len(s) or s[k].value != "+":
            return (text, dynamic) if known else None
        k += 1
    return (text, True) if known else None


def _call(s: list[Token], paren: int) -> tuple[str, int] | None:
    """Callee and number of the argument that is a URL, for a call whose parenthesis is token paren."""
    back = lambda j: s[paren - j] if paren >= j else Token("", "", False, 0)
    name, dot, owner = back(1), back(2), back(3)
    if name.kind != "ident":
        return None
    dotted = dot.kind == "punct" and dot.value == "."
    if dot.kind == "ident" and dot.value == "new":
        return (f"new {name.value}", 0) if name.value in CONSTRUCTORS else None
    if not dotted:
        return (name.value, 0) if name.value in ("fetch", "axios") else None
    full = f"{owner.value}.{name.value}"
    if name.value == "fetch" and owner.value in GLOBALS or name.value == "sendBeacon" or full == "window.open" or owner.value in RECEIVERS and name.value in METHODS:
        return full, 0
    if name.value == "open" and paren + 1 < len(s) and s[paren + 1].kind == "string" and s[paren + 1].value.upper() in VERBS:
        return full, 1
    return None


def _argument(s: list[Token], paren: int, number: int) -> int:
    """Where the argument begins, or the end of the stream."""
    level, k = 0, paren + 1
    while number and k < len(s):
        if s[k].kind == "punct":
            level += (s[k].value in "([{") - (s[k].value in ")]}")
            if level < 0:
                return len(s)
            number -= s[k].value == "," and level == 0
        k += 1
    return k


def endpoints(source: str) -> list[tuple[str, str, str, bool]]:
    """(value, source, callee, dynamic), distinct by value with the best source, sorted by value."""
    streams = lex(source)
    consts = _constants(streams)
    best: dict[str, tuple[str, str, str, bool]] = {}

    def add(value: str, kind: str, callee: str, dynamic: bool) -> None:
        if plausible(value) and (value not in best or RANK[kind] > RANK[best[value][1]]):
            best[value] = (value, kind, callee, dynamic)

    for s in streams:
        for k, t in enumerate(s):
            if t.kind == "punct" and t.value == "(" and (call := _call(s, k)):
                if found := _expression(s, _argument(s, k, call[1]), consts):
                    add(found[0], "call", call[0], found[1])
            elif t.value in URL_KEYS and t.kind in ("ident", "string") and k + 1 < len(s) and s[k + 1].kind == "punct" and s[k + 1].value in ":=":
                if (found := _expression(s, k + 2, consts)) and (found[0].startswith("/") or ABSOLUTE.match(found[0])):
                    add(found[0], "property", "", found[1])
            if t.kind in ("string", "template") and (found := _expression(s, k, consts)):
                if API_LIKE.match(found[0]) or (not found[1] and ABSOLUTE.match(found[0])):
                    add(found[0], "literal", "", found[1])
    return [best[v] for v in sorted(best, key=lambda v: v.encode())]


def _endpoint_rows(body: pd.Series) -> pd.Series:
    names = ("value", "source", "callee", "dynamic")
    return body.map(lambda b: [dict(zip(names, e, strict=True)) for e in endpoints(b)] if b else [])


def _literal_rows(body: pd.Series) -> pd.Series:
    return body.map(lambda b: literals(b) if b else b)


def _token_rows(body: pd.Series) -> pd.Series:
    return body.map(lambda b: [{"stream": i, "kind": t.kind, "value": t.value, "dynamic": t.dynamic, "offset": t.offset} for i, s in enumerate(lex(b)) for t in s] if b else [])


def _merged_rows(scripts: pd.Series) -> pd.Series:
    def merged(bodies) -> list[dict]:
        best: dict[str, dict] = {}
        for body in bodies if bodies is not None else ():
            for e in _endpoint_rows(pd.Series([body]))[0]:
                if e["value"] not in best or RANK[e["source"]] > RANK[best[e["value"]]["source"]]:
                    best[e["value"]] = e
        return [best[v] for v in sorted(best, key=lambda v: v.encode())]

    return scripts.map(merged)


def _joined_literals(scripts: pd.Series) -> pd.Series:
    return scripts.map(lambda bodies: None if bodies is None else "\n".join(literals(b) for b in bodies if b))


def _with_quotes(scripts: Column) -> Column:
    """Those scripts that hold a quote or backtick: others have no strings to find."""
    return F.filter(scripts, lambda s: s.rlike("[\"'`]"))


def script_endpoints(scripts: Column) -> Column:
    """Endpoints of a list of scripts, each a program of its own, in ENDPOINT: distinct by value, the best source kept."""
    ship_package()
    return F.pandas_udf(_merged_rows, ENDPOINT)(_with_quotes(scripts))


def script_literals(scripts: Column) -> Column:
    """String and template values of a list of scripts, a line each; null for null."""
    ship_package()
    return F.pandas_udf(_joined_literals, "string")(_with_quotes(scripts))


def js_endpoints(body: Column) -> Column:
    """Endpoints of a script, in ENDPOINT; none of a null one."""
    ship_package()
    return F.pandas_udf(_endpoint_rows, ENDPOINT)(F.when(body.rlike("[\"'`]"), body))


def js_literals(body: Column) -> Column:
    """String and template values of a script, a line each; null for null."""
    ship_package()
    return F.pandas_udf(_literal_rows, "string")(body)


def js_tokens(body: Column) -> Column:
    """Tokens of a script in stream order, in TOKENS; none of a null one."""
    ship_package()
    return F.pandas_udf(_token_rows, TOKENS)(body)


def endpoint_findings(found: Column) -> Column:
    """Endpoints as findings: calls and properties, and literals that begin with a slash."""
    text = lambda e: F.concat(F.when(e["source"] == "call", F.concat(e["callee"], F.lit("()"))).when(e["source"] == "property", F.lit("url property")).otherwise(F.lit("string literal")), F.when(e["dynamic"], F.lit(", built at runtime")).otherwise(F.lit("")))
    kept = F.filter(found, lambda e: (e["source"] != "literal") | e["value"].startswith("/"))
    return F.transform(kept, lambda e: F.struct(F.lit("api-endpoint").alias("kind"), e["value"].alias("value"), text(e).alias("evidence")))


def static_references(found: Column) -> Column:
    """Values that are complete in the source: references to crawl."""
    return F.transform(F.filter(found, lambda e: ~e["dynamic"]), lambda e: e["value"])
