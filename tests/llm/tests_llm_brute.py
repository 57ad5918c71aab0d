"""Brute force shared by tests."""

import re


def removed(rows, size=13):
    """id -> words left after the windows that a smaller id also has are gone."""
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t) for i, t in rows}
    least = {}
    for i in sorted(words):
        for k in range(len(words[i]) - size + 1):
            least.setdefault(tuple(words[i][k : k + size]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if least[tuple(w[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        out[i] = [x for x, g in zip(w, gone, strict=True) if not g]
    return out
