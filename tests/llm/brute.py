"""Plain Python versions that the tests compare with."""

import itertools
import re


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def folded(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded(text))


def shingles(text, n):
    words = plain_words(folded(text))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute_components(rows, n, percent):
    """Smallest id of each row's component; rows are (id or None, text)."""
    big, sets = 1 << 62, [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            root[top(i)] = top(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), big), big if doc is None else doc)
    return sorted((big if d is None else d, len(sets[i]), least[top(i)]) for i, (d, _) in enumerate(rows))
