"""Which candidates are secrets and which are references, placeholders or fragments of patterns."""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a name of a secret has, roots of configuration objects, calls that read configuration.
TERMS = ("api", "key", "secret", "token", "password", "passwd", "pwd", "credential", "credentials", "client")
ROOTS = ("config", "configuration", "connectionstrings", "credentials", "data", "env", "environment", "local", "module", "os", "process", "secret", "secrets", "settings", "var", "variables", "vault")
ACCESSORS = ("os.getenv", "os.environ", "process.env", "env.fetch", "config.get", "configuration.get", "settings.get", "vault.read", "secret.get", "secrets.get")
FRAGMENTS = ("[^", r"\s", r"\w", "(?:", "(?i)")
WRAPS = (("${", "}"), ("%{", "}"), ("{{", "}}"), ("$(", ")"), ("$[", "]"))
SCHEMES = ("vault://", "ref+vault://")
#: Names that a value is assigned to; a sign inside may be an underscore, a hyphen or none.
KEYS = tuple(k.replace("~", sign) for k in ("password", "passwd", "pwd", "secret", "token", "api~key", "client~secret", "credential", "credentials") for sign in (("_", "-", "") if "~" in k else ("",)))
LEAST_BYTES = 8
_SPACE = "\t\n\f\r "
_WORD, _PATH, _DOTS = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*", re.ASCII), re.compile(r"[A-Za-z_][A-Za-z0-9_.]*\Z", re.ASCII), re.compile(r"\.(?:[0-9.]|\Z)")
_BLANK_LINE = re.compile(r"\n[ \t\r]*\n")


def is_path(text: str) -> bool:
    """Whether a text is names joined by dots."""
    return bool(_PATH.match(text)) and not _DOTS.search(text)


def _names_elsewhere(t: str) -> bool:
    """Shapes that are references whatever they name."""
    low = t.lower()
    if any(t.startswith(a) and t.endswith(b) and len(t) >= len(a) + len(b) for a, b in WRAPS) or low.startswith(SCHEMES):
        return True
    if t[0] == t[-1] and t[0] in "%!" and is_path(t[1:-1]) or t[0] == "$" and is_path(t[1:]):
        return True
    return low.startswith("enc[") and t.endswith("]") or any(low.startswith(a) and low[len(a) :].lstrip(_SPACE)[:1] in ("[", "(", ".") for a in ACCESSORS)


def is_reference(value: str) -> bool:
    """Whether a value names a secret that is kept elsewhere."""
    t = value.strip().strip("'\"")
    if len(t.encode("utf-8", "surrogateescape")) < 2:
        return False
    if _names_elsewhere(t):
        return True
    if not is_path(t) or not any(term in t.lower() for term in TERMS):
        return False
    longest = max(map(len, re.split(r"[._]", t)))
    if "." in t:
        return t.removeprefix("_").partition(".")[0].lower() in ROOTS and longest < 32
    return ("_" in t or t == t.upper()) and longest < 12


def assigned_values(text: str) -> Iterator[str]:
    """What a text assigns to names of secrets: from each equals sign back to the name, and on to the value's end.

    A name stands at the start, or behind a semicolon or white space; a value is quoted, or goes up to those.
    """
    stops, longest = _SPACE + ";", max(map(len, KEYS))
    at = 0
    while (sign := text.find("=", at)) >= 0:
        end = sign
        while end > at and text[end - 1] in _SPACE:
            end -= 1
        begin = end
        while begin > at and end - begin <= longest and text[begin - 1] not in stops:
            begin -= 1
        at, own = sign + 1, text[begin:end].lower() in KEYS and (begin == 0 or text[begin - 1] in stops)
        if not own:
            continue
        while at < len(text) and text[at] in _SPACE:
            at += 1
        close = text.find(text[at], at + 1) + 1 if text[at : at + 1] in ("'", '"') else 0
        if not close:
            close = at
            while close < len(text) and text[close] not in stops:
                close += 1
        if close > at:
            yield text[at:close]
        at = max(at, close)


def has_placeholder_assignment(value: str) -> bool:
    """Whether some ``password=...`` inside a candidate is given a reference."""
    for found in assigned_values(value):
        t = found.strip().strip("\"'")
        if t.startswith("${") and "}" in t:
            t = t[: t.index("}") + 1]
        if is_reference(t):
            return True
    return False


def is_member_chain(expression: str) -> bool:
    """Whether an expression is names joined by dots, with an index or a call (of up to 200 characters) behind them or not."""
    found = _WORD.match(expression)
    chain = found[0] if found else ""
    if "." not in chain or not is_path(chain):
        return False
    rest = expression[len(chain) :].strip()
    if rest.startswith("["):
        inner, closed, rest = rest[1:].partition("]")
        if not closed or not 1 <= len(inner) <= 200:
            return False
        rest = rest.strip()
    return not rest or rest[0] == "(" and rest[-1] == ")" and 2 <= len(rest) <= 202


def is_plausible(secret: str) -> bool:
    if len(secret.strip().encode("utf-8", "surrogateescape")) < LEAST_BYTES or set(secret) in ({"0"}, {"x"}):
        return False
    return not (is_reference(secret) or has_placeholder_assignment(secret) or any(f in secret for f in FRAGMENTS))


def is_assigned_reference(content: str, start: int) -> bool:
    """Whether an assigned value goes on as a member or a call, up to the end of line or statement."""
    rest = re.split(r"[\n\r;]", content[start:], maxsplit=1)[0]
    expression = rest.strip().rstrip(",>/").strip("\"'").strip()
    if not expression:
        return False
    if is_reference(expression):
        return True
    return content[start - 1 : start] not in ("'", '"') and is_member_chain(expression)


def crosses_blank_line(between: str) -> bool:
    return bool(_BLANK_LINE.search(between))


def decode_base64(value: str) -> bytes | None:
    """The payload of a base64 or base64url run, or None. Padded forms must be right to the character."""
    body = value.rstrip("=")
    url = "-" in body or "_" in body
    if len(body) % 4 == 1 or url and ("+" in body or "/" in body):
        return None
    if len(body) != len(value) and len(value) % 4:
        return None
    try:
        return base64.b64decode(body.translate(str.maketrans("-_", "+/")) + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


# The same rules as columns.


def _path(t: Column) -> Column:
    # no repeated group: Java matches those by recursion
    return t.rlike(r"^[A-Za-z_][A-Za-z0-9_.]*\z") & ~t.rlike(r"\.(?:[0-9.]|\z)")


def _any(conditions: Iterable[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out |= c
    return out


def reference(value: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(value, r"^[\t\n\x0b\f\r ]+|[\t\n\x0b\f\r ]+$", ""), "^['\"]+|['\"]+$", "")
    lower, parts, n = F.lower(t), F.split(t, "[._]"), F.length(t)
    inner = F.substring(t, F.lit(2), n - 2)
    wrapped = _any(t.startswith(a) & t.endswith(b) & (n >= len(a) + len(b)) for a, b in WRAPS) | _any(lower.startswith(x) for x in SCHEMES)
    marked = _any(t.startswith(c) & t.endswith(c) & _path(inner) for c in "%!") | (t.startswith("$") & _path(F.substring(t, F.lit(2), n)))
    read = (lower.startswith("enc[") & t.endswith("]")) | lower.rlike(rf"^(?:{'|'.join(map(re.escape, ACCESSORS))})[{_SPACE}]*[.\[(]")
    longest = F.array_max(F.transform(parts, F.length))
    root = F.lower(F.substring_index(F.regexp_replace(t, "^_", ""), ".", 1))
    dotted = root.isin(*ROOTS) & (longest < 32)
    plain = (t.contains("_") | (t == F.upper(t))) & (longest < 12)
    named = _path(t) & _any(lower.contains(x) for x in TERMS) & F.when(t.contains("."), dotted).otherwise(plain)
    return F.when(F.octet_length(t) < 2, F.lit(False)).otherwise(wrapped | marked | read | named)


def placeholder(value: Column) -> Column:
    """``has_placeholder_assignment``: the values assigned to ``KEYS`` inside a candidate."""
    pattern = rf"(?i)(?:^|[;{_SPACE}])(?:{'|'.join(sorted(KEYS, key=len, reverse=True))})[{_SPACE}]*=[{_SPACE}]*(\"[^\"]*\"|'[^']*'|[^;{_SPACE}]+)"
    cut = lambda v: F.regexp_replace(F.regexp_replace(v, "^['\"]+|['\"]+$", ""), r"^(\$\{[^}]*\})[\s\S]*$", "$1")
    return F.exists(F.regexp_extract_all(value, F.lit(pattern), F.lit(1)), lambda v: reference(cut(v)))


def blank_line(between: Column) -> Column:
    """``crosses_blank_line``."""
    return between.rlike(r"\n[ \t\r]*\n")


def fragment(value: Column) -> Column:
    out = F.lit(False)
    for x in FRAGMENTS:
        out |= value.contains(x)
    return out


def plausible(value: Column) -> Column:
    """``is_plausible``."""
    bare = F.regexp_replace(value, r"^[\t\n\x0b\f\r ]+|[\t\n\x0b\f\r ]+$", "")
    return (F.octet_length(bare) >= LEAST_BYTES) & ~value.rlike(r"^(?:0+|x+)\z") & ~reference(value) & ~placeholder(value) & ~fragment(value)
