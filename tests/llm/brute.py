"""Plain single-process versions of the operators' contracts, to hold the operators against."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def components(nodes, links) -> dict:
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return {n: root(n) for n in nodes}


def shingle_set(text) -> frozenset:
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(zip(*(words[i:] for i in range(5)), strict=False)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def jaccard_groups(docs: list[tuple]) -> dict:
    """doc_id -> (shingles, component) by an inverted index."""
    sets = {d: shingle_set(t) for d, t in docs}
    where = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    links = []
    for d, s in sets.items():
        for other, both in Counter(o for x in s for o in where[x] if o < d).items():
            if 100 * both >= 80 * (len(s) + len(sets[other]) - both):
                links.append((other, d))
    found = components(sets, links)
    return {d: (len(s), found[d]) for d, s in sets.items()}


def repeats(docs: list[tuple], length: int = 400) -> list[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row."""
    raw = [(t or "").encode() for _, t in docs]
    often = Counter(hash(b[i : i + length]) for b in raw for i in range(len(b) - length + 1))
    out = []
    for (d, _), b in zip(docs, raw, strict=True):
        gone = np.zeros(len(b) + 1, dtype=int)
        for i in range(len(b) - length + 1):
            if often[hash(b[i : i + length])] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        mask = np.cumsum(gone)[:-1] > 0
        kept = bytes(np.frombuffer(b, dtype=np.uint8)[~mask])
        spans = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        out.append((d, len(b), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def vector_groups(rows: list[tuple], cosine: float = 0.98) -> dict:
    """vec_id -> (links, component, kept)"""
    sound = {}
    for i, v, label in rows:
        if v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            sound[i] = (label, np.asarray(v, dtype="float64"))
    links = []
    keys = list(sound)
    for n, a in enumerate(keys):
        for b in keys[:n]:
            (la, x), (lb, y) = sound[a], sound[b]
            if la == lb and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                links.append((a, b))
    count, found = Counter(x for pair in links for x in pair), components([r[0] for r in rows], links)
    return {i: (count[i], found[i], found[i] == i) for i, _, _ in rows}


def base_figures(text) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)"""
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    marked = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(marked)


def targets(sizes: dict, weights=(1, 2, 3), cap=3.0) -> dict:
    """source -> target, by resharing the excess until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = total - sum(fixed.values())
        free = {s: w for s, w in weight.items() if s not in fixed}
        share = {s: rest * w / sum(free.values()) for s, w in free.items()}
        above = [s for s in free if share[s] > cap * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in above}


def quality_verdicts(docs: list[tuple], least: dict, tail=0.8, spread=5.0, sampling=3.0, least_docs=50) -> dict:
    """doc_id -> (kept, how near the nearest fence is, relative to it) of (doc_id, text, lang, source), by exact quantiles of each group."""
    measured, groups = {}, defaultdict(list)
    for d, text, lang, source in docs:
        n_words, word_chars, n_symbols, n_dup, n_repeat = base_figures(text)
        lines = sum(bool(WORD.search(x)) for x in (text or "").split("\n"))
        capitals = sum(unicodedata.category(c) == "Lu" for c in text or "")
        w, c, n = max(1, n_words), max(1, word_chars), max(1, lines)
        failed = n_words < 10 or 100 * n_repeat > 20 * n_words
        ratios = {"symbols": (n_symbols / w, w), "repeated_lines": (n_dup / n, n), "capitals": (capitals / c, c), "letters": (word_chars / w, w)}
        measured[d] = (failed, ratios, lang, source)
        if not failed:
            for key in ((lang, source), (lang,), ()):
                groups[key].append(ratios)
    exact = lambda xs, p: sorted(xs)[max(0, -(-int(round(p * len(xs) * 1e9)) // 10**9) - 1)]
    fences = {}
    for key in [k for k in groups if len(k) == 2]:
        of = next((k for k in (key, key[:1]) if len(groups[k]) >= least_docs), ())
        for name in least:
            xs = [r[name][0] for r in groups[of]]
            low, mid, high = (exact(xs, p) for p in (1 - tail, 0.5, tail))
            by = sampling * (mid / 2 if name == "letters" else max(high, least[name]) ** 0.5)
            fences[key, name] = (low - spread * max(mid - low, least[name]) if name == "letters" else -np.inf, high + spread * max(high - mid, least[name]), by)
    out = {}
    for d, (failed, ratios, lang, source) in measured.items():
        kept, near = not failed, np.inf
        if not failed:
            for name, (x, n) in ratios.items():
                lo, hi, by = fences[(lang, source), name]
                lo, hi = lo - by / n**0.5, hi + by / n**0.5
                kept &= lo <= x <= hi
                near = min(near, abs(x / hi - 1), abs(x / lo - 1) if np.isfinite(lo) else np.inf)
        out[d] = (kept, near)
    return out
