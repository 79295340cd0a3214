"""Suffix arrays by induced sorting (Nong, Zhang and Chan, 2009) and permuted common prefixes (Karkkainen, Manzini and Puglisi, 2009), in numpy.

The induction goes bucket by bucket; within a bucket all suffixes that are known take their predecessors along at once, in order, so that the Python steps number the
symbols and the runs of equal symbols, not the characters.
"""

from __future__ import annotations

import numpy as np


def _types(text: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the next one. The last symbol is a unique least one."""
    n = len(text)
    rise = np.sign(np.diff(text.astype(np.int64))).astype(np.int8)
    where = np.where(rise != 0, np.arange(n - 1), n)
    where = np.minimum.accumulate(where[::-1])[::-1]
    small = np.ones(n, dtype=bool)
    small[:-1] = rise[np.minimum(where, n - 2)] > 0
    return small


def _spread(queue: np.ndarray, key: np.ndarray, place: np.ndarray, out: np.ndarray, step: int) -> None:
    """Append the suffixes of queue, in order, to the buckets of their symbols; step -1 fills them from the end."""
    order = np.argsort(key, kind="stable")
    k, q = key[order], queue[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    size = np.diff(np.append(first, len(k)))
    out[np.repeat(place[k[first]], size) + step * (np.arange(len(k)) - np.repeat(first, size))] = q
    place[k[first]] += step * size


def _induce(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the leftmost-smaller ones (seeds) in order within their buckets."""
    n, symbols = len(text), len(starts) - 1
    out = np.empty(n, dtype=np.int64)
    seed_key = text[seeds]
    seed_order = np.argsort(seed_key, kind="stable")
    seeds, seed_at = seeds[seed_order], np.searchsorted(seed_key[seed_order], np.arange(symbols + 1))
    heads = starts[:-1].copy()
    used = [c for c in range(symbols) if starts[c] < starts[c + 1]]
    for c in used:  # larger suffixes, from the least bucket on
        done = starts[c]
        gone = []
        while heads[c] > done:
            front = out[done : heads[c]] - 1
            done = heads[c]
            front = front[front >= 0]
            front = front[~small[front]]
            own = text[front] == c
            if own.any():
                mine = front[own]
                out[heads[c] : heads[c] + len(mine)] = mine
                heads[c] += len(mine)
                front = front[~own]
            gone.append(front)
        last = seeds[seed_at[c] : seed_at[c + 1]] - 1
        last = last[last >= 0]
        gone.append(last[~small[last]])
        queue = np.concatenate(gone) if len(gone) > 1 else gone[0]
        if len(queue):
            _spread(queue, text[queue], heads, out, 1)
    tails = starts[1:] - 1
    for c in reversed(used):  # smaller suffixes, from the largest bucket back
        done = starts[c + 1] - 1
        gone = []
        while tails[c] < done:
            front = out[tails[c] + 1 : done + 1][::-1] - 1
            done = tails[c]
            front = front[front >= 0]
            front = front[small[front]]
            own = text[front] == c
            if own.any():
                mine = front[own]
                out[tails[c] - len(mine) + 1 : tails[c] + 1] = mine[::-1]
                tails[c] -= len(mine)
                front = front[~own]
            gone.append(front)
        larger = out[starts[c] : heads[c]][::-1] - 1
        larger = larger[larger >= 0]
        gone.append(larger[small[larger]])
        queue = np.concatenate(gone)
        if len(queue):
            _spread(queue, text[queue], tails, out, -1)
    out[0] = n - 1
    return out


def _by_doubling(names: np.ndarray) -> np.ndarray:
    """Order of all suffixes of a short text with many symbols, where buckets would hold one suffix each."""
    n, rank, step = len(names), names.astype(np.int64), 1
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        step *= 2
        if new[-1] == n - 1 or step >= n:
            return order


def suffix_array(text: np.ndarray) -> np.ndarray:
    """text: non-negative integers that end with a unique least one."""
    n, symbols = len(text), int(text.max()) + 1
    if n <= 2:
        return np.arange(n)[::-1].copy()
    if symbols > 4096:
        return _by_doubling(text)
    small = _types(text)
    starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
    seeds = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(seeds) < 2:
        return _induce(text, small, seeds, starts)
    order = _induce(text, small, seeds, starts)
    is_seed = np.zeros(n, dtype=bool)
    is_seed[seeds] = True
    order = order[is_seed[order]]
    # Name the leftmost-smaller substrings: equal ones have one length and equal symbols, compared column by column.
    length = np.zeros(n, dtype=np.int64)
    length[seeds] = np.append(np.diff(seeds), 0) + 1
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    at, width = np.flatnonzero(same), 0
    while len(at):
        differ = text[a[at] + width] != text[b[at] + width]
        same[at[differ]] = False
        width += 1
        at = at[~differ & (length[a[at]] > width)]
    name = np.zeros(n, dtype=np.int64)
    name[order] = np.concatenate([[0], np.cumsum(~same)])
    names = name[seeds]
    if names.max() + 1 < len(names):
        order = seeds[suffix_array(names)]
    return _induce(text, small, order, starts)


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int, breaks: np.ndarray | None = None) -> np.ndarray:
    """PLCP: of each suffix the length of the prefix it shares with the one before it in order.

    Only irreducible values, where the symbols before both suffixes differ, and those at `breaks` are compared, up to `most` symbols; the others are one less than their left
    neighbour's. So a value is exact, or at least `most` less the distance to the compared position on its left.
    """
    n = len(text)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    reducible = (at > 0) & (before > 0) & (text[at - 1] == text[before - 1])
    reducible[1:] &= before[1:] == before[:-1] + 1
    if breaks is not None:
        reducible[breaks] = False
    todo = np.flatnonzero(~reducible & (before >= 0))
    padded = np.concatenate([text, np.arange(-most - 2, 0)])
    value = np.zeros(n, dtype=np.int64)
    length = 0
    while len(todo) and length <= most:
        hold = (np.maximum(todo, before[todo]) + length < n) & (padded[todo + length] == padded[before[todo] + length])
        value[todo[~hold]] = length
        todo, length = todo[hold], length + 1
    value[todo] = length
    first = np.where(reducible, -1, at)
    first = np.maximum.accumulate(first)
    return np.maximum(0, value[first] - (at - first))
