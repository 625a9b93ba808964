"""Examples of what a pattern matches, made from the pattern itself: for self-checks of detectors and for planted secrets."""

from __future__ import annotations

import random
import re
from re import _constants as kinds
from re import _parser as parser

_SPACES = {kinds.CATEGORY_SPACE: r"\s", kinds.CATEGORY_NOT_SPACE: r"\S", kinds.CATEGORY_WORD: r"\w", kinds.CATEGORY_DIGIT: r"\d"}


def _member(items: list, rng: random.Random) -> str:
    """A character of a class: a letter or digit if it has any."""
    inside: set[int] = set()
    negated = items[0][0] is kinds.NEGATE
    for kind, value in items[negated:]:
        if kind is kinds.LITERAL:
            inside.add(value)
        elif kind is kinds.RANGE:
            inside.update(range(value[0], value[1] + 1))
        else:
            inside.update(c for c in range(32, 127) if re.match(_SPACES[value], chr(c)))
    own = sorted(set(range(33, 127)) - inside if negated else inside)
    return chr(rng.choice([c for c in own if chr(c).isalnum()] or own))


def _gap(low: int, high: int, what: list) -> bool:
    """Whether a repeat is a gap between words: any characters, none needed."""
    return low == 0 and high > 10 and (what[0][0] is kinds.NOT_LITERAL or what[0][0] is kinds.IN and (what[0][1][0][0] is kinds.NEGATE or len(what[0][1]) > 1 and what[0][1][0][0] is kinds.CATEGORY))


def _made(tree, rng: random.Random) -> str:
    out = []
    for kind, value in tree:
        if kind is kinds.LITERAL:
            out.append(chr(value))
        elif kind is kinds.NOT_LITERAL:
            out.append("x" if value == 32 else " ")
        elif kind is kinds.ANY:
            out.append(".")
        elif kind is kinds.IN:
            out.append(_member(value, rng))
        elif kind is kinds.BRANCH:
            out.append(_made(rng.choice(value[1]), rng))
        elif kind is kinds.SUBPATTERN:
            out.append(_made(value[3], rng))
        elif kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT):
            low, high, what = value
            out += [" "] if _gap(low, high, what) else [_made(what, rng) for _ in range(low)]
    return "".join(out)


def example(pattern: str, flags: int = 0, seed: object = 0) -> str:
    """A short text made after a pattern; bounds and looks around are ignored, so it may have to be tried with another seed."""
    return _made(parser.parse(pattern, flags | re.ASCII), random.Random(f"{seed}"))
