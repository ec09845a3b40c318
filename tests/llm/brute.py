"""Plain, slow versions of the operators, for small tables."""

from __future__ import annotations

import re


def shingle_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text or ""))
    if not words:
        return frozenset()
    if len(words) < k:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def jaccard_components(rows, k, percent):
    """[(doc_id, n, component)] by comparing all pairs of distinct sets."""
    sets = [shingle_set(t, k) for _, t in rows]
    distinct = sorted({s for s in sets if s}, key=len)
    parent = {s: s for s in distinct}

    def find(s):
        while parent[s] is not s:
            s = parent[s]
        return s

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if len(a) * 100 < percent * len(b):
                break
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both):
                x, y = find(a), find(b)
                parent[x] = y
    low = {}
    for (doc, _), s in zip(rows, sets):
        if s and doc is not None:
            low[find(s)] = min(low.get(find(s), doc), doc)
    return [(doc, len(s), low.get(find(s)) if s else doc) for (doc, _), s in zip(rows, sets)]


SPACE = " \t\n\x0b\x0c\r"


def frequent_lines_dropped(rows, min_docs, count_copies=True):
    """[(doc_id, n_lines, n_dropped, kept)]"""
    keys = lambda t: [ascii_lower(x.strip(SPACE)) for x in (t or "").split("\n")]
    counts = {}
    texts = [t for _, t in rows] if count_copies else {t or "": t for _, t in rows}.values()
    for t in texts:
        for k in set(keys(t)):
            counts[k] = counts.get(k, 0) + 1
    out = []
    for doc, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, keys(t)) if not k or counts[k] < min_docs]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or ""))


def contamination(rows, bench, width):
    """[(doc_id, n_words, n_hit, sorted item names)]"""
    windows = []
    for item, t in bench:
        w = bench_words(t)
        m = min(width, len(w))
        windows += [(item, w[i : i + m]) for i in range(len(w) - m + 1) if m]
    out = []
    for doc, t in rows:
        w = bench_words(t)
        hit, items = set(), set()
        for item, win in windows:
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    items.add("" if item is None else str(item))
        out.append((doc, len(w), len(hit), sorted(items)))
    return out


def top_k(rows, k, every):
    """[(query_id, rank, vec_id, score)] of integer vectors floor(1024 x)."""
    import math

    usable = []
    for vec_id, v in rows:
        if vec_id is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable.append((vec_id, [math.floor(1024 * x) for x in v]))
    out = []
    for i, (query, q) in enumerate(usable):
        if query % every:
            continue
        scores = sorted(
            (-sum(a * b for a, b in zip(q, v)), vec_id) for j, (vec_id, v) in enumerate(usable) if j != i
        )
        out += [(query, r + 1, vec_id, -s) for r, (s, vec_id) in enumerate(scores[:k])]
    return out
