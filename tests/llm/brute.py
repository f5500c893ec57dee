"""Slow and simple versions of the operators, to test against."""

from __future__ import annotations

import re
from collections import defaultdict


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingles(text, words):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1)))


def near_duplicates(docs, words, percent):
    """{doc_id: (n_shingles, component)} by an inverted index of shingles."""
    sets = {k: shingles(t, words) for k, t in docs}
    holders = defaultdict(list)
    for k, s in sets.items():
        for g in s:
            holders[g].append(k)
    common = defaultdict(int)
    for ks in holders.values():
        for i, a in enumerate(ks):
            for b in ks[:i]:
                common[a, b] += 1
    links = [(a, b) for (a, b), n in common.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    comp = components(sets, links)
    return {k: (len(s), comp[k]) for k, s in sets.items()}


def repeats(docs, length):
    """{doc_id: (n_bytes, n_removed, n_spans, kept bytes)} by a set of all strings seen."""
    seen, out = set(), {}
    for k, text in sorted(docs, key=lambda d: d[0]):
        t = (text or "").encode()
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            else:
                seen.add(w)
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[k] = (len(t), len(t) - len(kept), spans, kept)
    return out


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def licenses(text, phrases):
    """(n_words, n_base, first_word, last_word, base_labels) by comparing words."""
    w = [x.decode() for x in WORD.findall((text or "").encode().lower())]
    found = [(i, label) for label, p in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def license_labels(text, votes, coverage, slack):
    """(labels, score) by counting, template by template."""
    w = [x.decode() for x in WORD.findall((text or "").encode().lower())]
    templates = defaultdict(list)
    for t, label, phrase, n, i, a, b in votes:
        templates[t, label, phrase, n].append((i, a, b))
    labels, best = set(), 0.0
    for (_, label, phrase, n), pairs in templates.items():
        lines = defaultdict(list)
        for i, a, b in pairs:
            for p in range(len(w) - 1):
                if w[p] == a and w[p + 1] == b:
                    lines[p - i].append(p)
        spans, last = [], None
        for d in sorted(lines):
            if phrase or last is None or d - last > slack:
                spans.append([])
            spans[-1] += lines[d]
            last = d
        for s in spans:
            dense = 2 * len(s) >= max(s) - min(s) + 1
            share = min(len(s) / n, 1.0)
            if len(s) == n if phrase else share >= coverage and dense:
                labels.add(label)
            if len(s) == n if phrase else dense:
                best = max(best, share)
    return ",".join(sorted(labels)), round(best, 9)


def near_vectors(rows, threshold):
    """[(vec_id, n_links, component)] of (vec_id, vector, label) by all cosines."""
    import numpy as np

    ok = [v is not None and y is not None and None not in v and np.isfinite(v).all() and any(v) for _, v, y in rows]
    links, count = [], [0] * len(rows)
    for label in {y for _, _, y in rows}:
        at = [i for i, r in enumerate(rows) if ok[i] and r[2] == label]
        if at:
            u = np.array([rows[i][1] for i in at], float)
            u /= np.sqrt((u * u).sum(axis=1))[:, None]
            near = u @ u.T >= threshold
            for x, i in enumerate(at):
                count[i] = int(near[x].sum()) - bool(near[x, x])
                links += [(rows[i][0], rows[at[y]][0]) for y in np.flatnonzero(near[x]) if y < x]
    comp = components({r[0] for r in rows}, links)
    return [(r[0], c, comp[r[0]]) for r, c in zip(rows, count)]
