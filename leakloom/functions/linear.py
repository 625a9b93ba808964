"""All matches of a pattern in many texts, in time linear in the texts whatever they hold.

Patterns run on the automaton engine that Arrow carries (RE2), in a table's column at a time: a first pass tells which texts have a
match, a second one marks all matches of those at once. Bounds of words are the engine's ``\\b`` of ASCII words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

from .patterns import AFTER, BEFORE

#: Marks around a match and its secret; texts are searched with these characters replaced by another control character.
_REWRITE = "\x01\\1\x02\\2\x03\\3\x04"
_ODD = re.compile("[\x01-\x04\ud800-\udfff]")


def searchable(text: str) -> str:
    """The text as it is searched: as many characters, without marks and with undecodable bytes as U+FFFD."""
    return _ODD.sub(lambda m: "\x05" if m[0] < "\x05" else "\ufffd", text)


def form(pattern: str, group: int = 1) -> str | None:
    """The pattern in three groups: what is before its group, the group, and what is behind it.

    None where the group is inside another one, repeated, optional or not there; group 0 is the whole match.
    """
    p = pattern.replace(BEFORE, r"\b").replace(AFTER, r"\b")
    flags = re.match(r"(?:\(\?[a-zA-Z]+\))*", p)[0]
    p = p[len(flags) :]
    if group == 0:
        return f"{flags}()({_silent(p)})()"
    depth, seen, begin = 0, 0, None
    for kind, at in _brackets(p):
        if kind == ")":
            depth -= 1
            if begin is not None and depth == 0:
                if p[at + 1 : at + 2] in ("*", "+", "?", "{") or "|" in _outside(p):
                    return None
                return f"{flags}({_silent(p[:begin])})({_silent(p[begin + 1 : at])})({_silent(p[at + 1 :])})"
        else:
            if kind == "(" and depth == 0 and seen + 1 == group:
                begin = at
            seen += kind == "("
            depth += 1
    return None


def _outside(p: str) -> str:
    """What is outside all groups."""
    out, depth, last = [], 0, 0
    for kind, at in _brackets(p):
        if depth == 0:
            out.append(p[last:at])
        depth += -1 if kind == ")" else 1
        last = at + 1
    return "".join(out) + p[last:]


def _brackets(p: str) -> Iterator[tuple[str, int]]:
    """(kind, place) of brackets of groups: ``(`` captures, ``(?`` doesn't, ``)`` closes."""
    i, inside = 0, False
    while i < len(p):
        c = p[i]
        if c == "\\":
            i += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
            i += p[i + 1 : i + 2] == "^"
            i += p[i + 1 : i + 2] == "]"
        elif c == ")":
            yield c, i
        elif c == "(":
            yield ("(?" if p[i + 1 : i + 2] == "?" and p[i + 1 : i + 4] not in ("?P<",) else "("), i
        i += 1


def _silent(p: str) -> str:
    """The pattern without groups that capture."""
    out, last = [], 0
    for kind, at in _brackets(p):
        if kind == "(":
            named = re.compile(r"\(\?P<\w+>").match(p, at)
            out += [p[last:at], "(?:"]
            last = named.end() if named else at + 1
    return "".join(out) + p[last:]


def compiles(pattern: str) -> bool:
    """Whether the engine takes the pattern."""
    try:
        pc.match_substring_regex(pa.array([""]), pattern)
    except pa.ArrowInvalid:
        return False
    return True


def spans(texts: pa.Array, pattern: str) -> Iterator[tuple[int, int, int, int]]:
    """(text, start and end of the secret, start of the match) of all leftmost matches that don't overlap, in characters."""
    on = pc.indices_nonzero(pc.match_substring_regex(texts, pattern))
    if not len(on):
        return
    marked = pc.replace_substring_regex(texts if len(on) == len(texts) else texts.take(on), pattern, _REWRITE)
    for row, text in zip(on.to_pylist(), marked.to_pylist()):
        head, *matches = text.split("\x01")
        at = len(head)
        for match in matches:
            before, match = match.split("\x02", 1)
            secret, match = match.split("\x03", 1)
            after, rest = match.split("\x04", 1)
            start = at + len(before)
            yield row, start, start + len(secret), at
            at = start + len(secret) + len(after) + len(rest)
