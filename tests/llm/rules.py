"""Rules of the operators in plain Python, for tests."""

import re
from collections import Counter


def words(text):
    return (text or "").encode().lower().split()


def statistics(text):
    """(words, their characters, symbols, repeated lines, words in repeated windows) of a text."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = [False] * len(w)
    for i in range(len(w) - 4):
        if c[tuple(w[i : i + 5])] > 1:
            inside[i : i + 5] = [True] * 5
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text or ""), len(lines) - len(set(lines)), sum(inside)


def jaccard(a, b):
    x, y = (Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter() for w in (words(a), words(b)))
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def classes(rows):
    """The smallest id of the class of each id, of all pairs."""
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in rows:
        for j, b in rows:
            if i < j and words(a) and jaccard(a, b) >= 0.8:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in parent}
