"""Plain single-process statements of what the operators compute, for comparison on small tables."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_duplicates(rows):
    sets = {k: shingles(t) for k, t in rows}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = {}
    for k, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(k)
    pairs = {(a, b) for ks in by.values() for a in ks for b in ks if a < b}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: (len(s), find(k), find(k) == k) for k, s in sets.items()}


def contaminated(docs, items):
    sets = {k: shingles(t) for k, t in docs}
    out = set()
    for item, text in items:
        own = shingles(text)
        for doc, s in sets.items():
            if own and 100 * len(own & s) >= 75 * len(own):
                out.add((doc, item, len(own), len(own & s)))
    return out
