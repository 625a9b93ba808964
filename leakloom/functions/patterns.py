"""A compiler from detector specifications to patterns.

A specification states facts: the family, the anchor words, how far label and secret may be, the label
words, and the secret's shape in a small notation (``32–64×A-Za-z0-9``, quoted literals, ``≥n``,
``0–1×(...)``, ``one of a or b``, ``not chars``). What surrounds a secret may be stated in the same notation,
with ``<`` and ``>`` for the bounds of a word, ``~`` in a literal for an optional sign, ``L80`` and ``M160`` for
gaps, ``!chars`` for no such character before, ``=`` for an assignment, ``sep`` for separators and ``SECRET`` for the secret's place. Compiled patterns mean the same to Python's ``re`` with
``ASCII`` and to Java: only ASCII word characters bound a word, white space is tab, newline, form feed,
return and blank, and a dot stops at a newline.
"""

from __future__ import annotations

import re

SPACE = r"[\t\n\f\r ]"
BEFORE, AFTER = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"
#: Where a label isn't stated, these words (with ``~`` for an optional sign) label a secret.
LABELS = ("api~key", "access~key", "access~token", "auth~token", "client~secret", "secret~key", "token", "secret", "key", "password")
_TOKEN = re.compile(r'"[^"]*"|[()]|(?:\d+(?:–\d+)?|≥\d+)×|[^\s()]+(?:\(\)[^\s()]*)?')
QUOTE = r"['\"]?"
ASSIGNED = f"{SPACE}*[:=]{SPACE}*{QUOTE}"
SEPARATORS = r"['\"\t\n\f\r :=]+"


def alphabet(chars: str) -> str:
    """A character class of a stated alphabet such as ``A-Za-z0-9+/``; ``␠`` is a blank."""
    out, i = [], 0
    chars = chars.replace("␠", " ")
    while i < len(chars):
        c = chars[i]
        if c == "\\" and i + 1 < len(chars):
            out.append({"s": r"\t\n\f\r ", "w": "0-9A-Za-z_", "n": r"\n", "r": r"\r", "q": '"'}.get(chars[i + 1], re.escape(chars[i + 1])))
            i += 2
        elif i + 2 < len(chars) and chars[i + 1] == "-" and c.isalnum() and chars[i + 2].isalnum():
            out.append(chars[i : i + 3])
            i += 3
        else:
            out.append("\\" + c if c in r"\]^[-&~" else c)
            i += 1
    return "".join(out)


class _Shape:
    def __init__(self, shape: str, secret: str | None = None) -> None:
        self.tokens = _TOKEN.findall(shape)
        self.at = 0
        self.secret = secret

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1]

    def sequence(self, stop: tuple[str, ...] = ()) -> str:
        out = []
        while self.peek() is not None and self.peek() not in stop:
            out.append(self.element())
        return "".join(out)

    def choice(self) -> str:
        """After ``one of``: alternatives up to each ``or``; the last one is a single element."""
        parts = []
        while True:
            ahead, depth = self.at, 0
            while ahead < len(self.tokens) and (depth or self.tokens[ahead] not in ("or", ")", "one")):
                depth += {"(": 1, ")": -1}.get(self.tokens[ahead], 0)
                ahead += 1
            if ahead < len(self.tokens) and self.tokens[ahead] == "or":
                parts.append(self.sequence(("or",)))
                self.take()
            else:
                parts.append(self.element())
                return "(?:" + "|".join(parts) + ")"

    def element(self) -> str:
        t = self.take()
        if t == "one" and self.peek() == "of":
            self.take()
            return self.choice()
        if t == "(":
            inner = self.sequence((")",))
            self.take()
            return inner
        if self.secret is not None and (context := self.surrounding(t)) is not None:
            return context
        if t.startswith('"'):
            return re.escape(t[1:-1])
        if not t.endswith("×"):
            return re.escape(t)
        low, _, high = t[:-1].removeprefix("≥").partition("–")
        many = {("0", "1"): "?", ("1", "1"): ""}.get((low, high or low), "{%s,%s}" % (low, high) if high else "{%s}" % low)
        if t.startswith("≥"):
            many = {"0": "*", "1": "+"}.get(low, "{%s,}" % low)
        atom = self.take()
        if atom == "(":
            inner = self.sequence((")",))
            self.take()
            return f"(?:{inner}){many}"
        if atom == "not":
            return f"[^{alphabet(self.take())}]{many}"
        if atom.lower() == "any":
            lazy = self.peek() == "lazy" and bool(self.take())
            return r"[\s\S]" + many + "?" * lazy
        return f"[{alphabet(atom)}]{many}"


    def surrounding(self, t: str) -> str | None:
        """What only the notation of surroundings has; None for an element of a shape."""
        if t == "SECRET":
            return f"({self.secret})"
        if re.fullmatch(r"[LM]\d+", t):
            return gaps(t)[0]
        if t.startswith("!") and len(t) > 1:
            return f"(?<![{alphabet(t[1:])}])"
        if t.startswith('"'):
            return "[_-]?".join(map(re.escape, t[1:-1].split("~")))
        return {"<": BEFORE, ">": AFTER, "=": ASSIGNED, "sep": SEPARATORS, "quote": QUOTE}.get(t)


def secret_shape(shape: str) -> str:
    return _Shape(shape).sequence()


def _bounded(words: list[str]) -> str:
    """An alternation between word boundaries, longest first."""
    words = sorted(dict.fromkeys(words), key=lambda w: (-len(w), w))
    return f"(?:{'|'.join(words)})"


def anchor(keywords: list[str], closed: bool = True) -> str:
    """The provider's words; a blank, underscore or hyphen inside may be any of them or none.

    ``closed``: no word character follows, so that ``name_token`` isn't the word ``name``.
    """
    own = []
    for k in keywords:
        k = k.strip().lower()
        body = "".join("[ _-]?" if c in " _-" and 0 < i < len(k) - 1 else re.escape(c) for i, c in enumerate(k))
        own.append((BEFORE if k[:1].isalnum() else "") + body + (AFTER if closed and k[-1:].isalnum() else ""))
    return _bounded(own)


def label(labels: list[str]) -> str:
    return BEFORE + _bounded([re.escape(x.lower()).replace(r"\~", "[_-]?").replace("~", "[_-]?") for x in labels]) + AFTER


def gaps(stated: str) -> list[str]:
    """Patterns of the stated gaps: ``L80`` stays on a line, ``M160`` doesn't."""
    kinds = {"L": r"[^\n]", "M": r"[\s\S]"}
    return [kinds[g[0]] + "{0,%s}" % g[1:] for g in stated.split("+") if g and g[0] in kinds]


def within(context: str, shape: str, flags: str) -> str:
    """The pattern of a secret whose surroundings are stated; it stands at their end unless they place it."""
    end = AFTER if "b" in flags else ""
    stated = context if "SECRET" in context.split() else f"{context} SECRET"
    return _Shape(stated, secret_shape(shape)).sequence() + ("" if stated == context else end)


def assemble(family: str, keywords: list[str], stated_gap: str, labels: list[str], shape: str, flags: str) -> str:
    """The pattern of a specification; group 1 is the secret."""
    secret = f"({secret_shape(shape)})"
    end = AFTER if "b" in flags else ""
    space = gaps(stated_gap)
    if family in "LM":
        names = label(labels or list(LABELS))
        if len(space) > 1:
            words = [k.split(".")[0] for k in keywords]
            names = BEFORE + _bounded([re.escape(w.lower()) for w in words] + ["api[_-]?key", "token"])
            return anchor(keywords) + space[0] + names + f"[0-9A-Za-z_-]*{space[-1]}" + BEFORE + secret + end
        return anchor(keywords) + (space[0] if space else "") + names + ASSIGNED + secret + end
    if family == "S":
        return anchor(keywords, False) + "".join(space) + SEPARATORS + secret + end
    if family == "N":
        return anchor(keywords, False) + "".join(space) + BEFORE + secret + end
    if family == "A":
        return anchor(keywords) + ASSIGNED + secret + end
    return (BEFORE if family in "XU" and "u" not in flags else "") + secret + end
