"""Exact Jaccard join of word shingles by PartEnum signatures (Arasu, Ganti and Kaushik, "Efficient exact set-similarity joins", VLDB 2006).

Two sets with |A & B| >= 0.8 |A | B| differ in at most (|A| + |B|) / 9 elements, so in at most |A| / 4 if A is the smaller one. For each band of sizes the domain of hashed shingles is cut into ranges, and
a set of s shingles signs the first t of them, where t exceeds half of s / 4 + 1: at least one range then differs in at most one element. Each range is cut in three, and
each two of the three are enumerated: one of these three signatures agrees. A set signs in its own band and, if a partner may be there, in the next one. Sets of up to
SMALL shingles sign all their subsets that lack up to two elements instead.

d differences in t ranges change t + d of the 3 t signatures at most, so a pair agrees in 2 t - d or more. Where that is more than the signatures of empty parts that a set has, it leaves those out; of the
c agreements that are certain beyond them it may lose (c - 1) / 2 more, as may its partner, and one is left. A set gives up that many of its places in the largest buckets, those that passages shared by
many texts make.

Signatures travel as packed blocks, one for each batch and target partition. Sets that share one become a candidate pair; in buckets of more than STAR sets only pairs with the least set are
tried first. What large buckets hold is compared in tasks of bounded size, whose rows grow with their input, as no task writes pairs:

1. Every set has a sketch, its counts in equal ranges of the hashes: the sum of differences of two sketches is at most that of the sets, and pairs beyond (|A| + |B|) / 9 can't be similar. A task over the
   members of a bucket joins the components that could be linked by their sketches and returns a row for each component that it joined to a lesser one. Components joined over all buckets are a group; passages
   that many texts share join none.
2. A group is dealt once, with the sets themselves. A task counts shared shingles of sets that are not in one component yet, and returns a row for each component that a similar pair joined to a lesser one.

A bucket or group beyond one task is cut in blocks. Its largest component, where it is large, is one class of blocks and meets the others, never itself; sets of step 1 are classed by size, and meet only their own class and the next.

Shingles and sets are told apart by 64-bit hashes. Defined results: a text without words, or null, has an empty set and links with nothing; equal sets are one class; repeated rows are documents of their own with equal sets; a
null doc_id counts as larger than all others; an empty table gives an empty table; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import connected_components
from .hashing import U, WordHashes, mix, odd
from .shared import drop_stored, partitions, row_key, slices, small_or_not, stored

WIDTH, SMALL, STAR, GROWTH, SLACK = 5, 13, 4, 1.6, 1.3
#: Signatures held before they are sent; nodes of a bucket in one row; sets of a block in step 1, shingles of a block in step 2.
FLUSH, ROW, BLOCK, SHINGLES = 1 << 19, 1 << 16, 2000, 1 << 17
_words = WordHashes()


def shingles(text: str | None) -> np.ndarray:
    """The sorted hashes of a text's shingles."""
    words = _words.of((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not len(words):
        return words
    width = min(WIDTH, len(words))
    with np.errstate(over="ignore"):
        total = np.full(len(words) - width + 1, U(width))
        for j in range(width):
            total += words[j : len(words) - width + 1 + j] * odd(j)
    total = mix(total)
    total.sort()
    return total[np.concatenate([[True], total[1:] != total[:-1]])]


def fingerprint(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def sketch(found: np.ndarray) -> bytes:
    """Counts of a set in equal ranges of the hashes, up to 255: 128 ranges, or the next power of two over a sixteenth of a large set."""
    bits = max(7, (len(found) // 16).bit_length())
    counts = np.bincount((found >> U(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def _counts(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of one width; a wider one is folded, and stays a lower bound where it was cut at 255."""
    lengths = set(map(len, sketches))
    width = min(lengths)
    if len(lengths) == 1:
        return np.frombuffer(b"".join(sketches), dtype=np.uint8).reshape(-1, width).astype(np.int16)
    return np.stack([np.frombuffer(x, dtype=np.uint8).reshape(width, -1).sum(axis=1, dtype=np.int16) for x in sketches])


def ranges_for(differences: int) -> int:
    """How many ranges let one of them differ in one element at most, and some more, so that empty ones can be left out."""
    return -int(-SLACK * (differences + 1) / 2 // 1) + 1


@lru_cache(maxsize=None)
def bands() -> list[tuple[int, int, int]]:
    """(least size, largest size, ranges) of each band; the first one is that of small sets."""
    out, low = [(4, SMALL, 0)], SMALL + 1
    while low < 1 << 40:
        high = int(low * GROWTH)
        out.append((low, high, ranges_for(high // 4)))
        low = high + 1
    return out


def _subsets(found: np.ndarray) -> np.ndarray:
    m = mix(found ^ U(0xA5A5A5A5))
    with np.errstate(over="ignore"):
        whole = m.sum(dtype=U)
        out = [np.array([whole]), whole - m]
        if len(m) > 7:
            i, j = np.triu_indices(len(m), 1)
            out.append(whole - m[i] - m[j])
    return mix(np.concatenate(out))


@lru_cache(maxsize=None)
def _geometry(number: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the thirds of a band's ranges, and what tells its signatures apart by their place."""
    ranges = bands()[number][2]
    edges = np.minimum(np.arange(1, 3 * ranges + 1) * (2.0**64 / (3 * ranges)), 2.0**64 - 2048).astype(U)
    return edges, mix((np.arange(3 * ranges, dtype=U) + U(number << 40)) * U(0xD1342543DE82EF95)).reshape(ranges, 3)


def _in_band(found: np.ndarray, number: int) -> tuple[np.ndarray, int]:
    """Signatures of a set in one band, and how many of them it can do without."""
    low, high, ranges = bands()[number]
    if not ranges:
        return _subsets(found), 0
    size = len(found)
    t = min(ranges, ranges_for(size // 4))
    edges, keys = _geometry(number)
    ends = np.searchsorted(found, edges[: 3 * t])
    if t == ranges:
        ends[-1] = size
    sums = np.zeros(size + 1, dtype=U)
    with np.errstate(over="ignore"):
        np.cumsum(mix(found ^ U(0x5A5A5A5A)), dtype=U, out=sums[1:])
        starts = np.concatenate([[0], ends[:-1]])
        part, full = (sums[ends] - sums[starts]).reshape(t, 3), (ends > starts).reshape(t, 3)
        out = mix(keys[:t] + part * odd(11) + part[:, [1, 2, 0]] * odd(12))
    empty = ~(full | full[:, [1, 2, 0]])
    most = np.arange(int(0.8 * size) // 4, size // 4 + 1)  # differences that a pair of this set may have at most
    first = np.minimum(t, np.ceil(SLACK * (most + 1) / 2).astype(int) + 1)
    certain = int((2 * first - most - np.cumsum(empty.sum(axis=1))[first - 1]).min())
    return (out[~empty], (certain - 1) // 2) if certain > 0 else (out.ravel(), 0)


def signatures(found: np.ndarray) -> tuple[np.ndarray, int]:
    """All signatures of a set, and how many of them it can do without."""
    size = len(found)
    out = []
    for number, (low, high, _) in enumerate(bands()):
        if low > size * 1.25:
            break
        if size <= high and (size >= low or number):
            out.append(_in_band(found, number))
    return (np.concatenate([x for x, _ in out]), min(spare for _, spare in out)) if out else (np.zeros(0, dtype=U), 0)


_PAIR = np.dtype([("sig", "<u8"), ("node", "<i8")])
_OUT = pa.schema([("part", pa.int32()), ("block", pa.binary()), ("doc_id", pa.int64()), ("row", pa.int64()), ("node", pa.int64()), ("size", pa.int64()), ("spare", pa.int64()), ("sketch", pa.binary())])
_OUT_SQL = "part int, block binary, doc_id long, row long, node long, size long, spare long, sketch binary"


def _signed(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, sigs, nodes, held = {}, [], [], 0

        def flush():
            sig, node = np.concatenate(sigs), np.concatenate(nodes)
            to = (sig % U(parts)).astype(np.int32)
            order = np.argsort(to, kind="stable")
            pairs = np.empty(len(sig), dtype=_PAIR)
            pairs["sig"], pairs["node"] = sig[order], node[order]
            at = np.concatenate([[0], np.cumsum(np.bincount(to, minlength=parts))])
            full = np.flatnonzero(np.diff(at))
            blocks = [pairs[at[p] : at[p + 1]].tobytes() for p in full]
            none = pa.nulls(len(full), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(blocks, pa.binary()), none, none, none, none, none, pa.nulls(len(full), pa.binary())], schema=_OUT)

        for batch in batches:
            info = []
            for text in batch.column("text"):
                found = shingles(text.as_py())
                node = fingerprint(found)
                if node not in seen:
                    sig, seen[node] = signatures(found)
                    sigs.append(sig)
                    nodes.append(np.full(len(sig), node))
                    held += len(sig)
                info.append((node, len(found), seen[node], sketch(found)))
                if held > FLUSH:
                    yield from slices(flush())
                    seen, sigs, nodes, held = {}, [], [], 0
            rows = batch.column("row")
            part = pa.array((rows.to_numpy() % parts).astype(np.int32))
            node, size, spare = (pa.array([x[i] for x in info], pa.int64()) for i in range(3))
            yield pa.RecordBatch.from_arrays([part, pa.nulls(len(info), pa.binary()), batch.column("doc_id"), rows, node, size, spare, pa.array([x[3] for x in info], pa.binary())], schema=_OUT)
        if held:
            yield from slices(flush())

    return run


_FOUND = pa.schema([*(_OUT.field(x) for x in ("doc_id", "row", "node", "size", "spare", "sketch")), ("a", pa.int64()), ("b", pa.int64()), ("bucket", pa.int64()), ("nodes", pa.binary()), ("sets", pa.int64()), ("times", pa.int64())])
_FOUND_SQL = "doc_id long, row long, node long, size long, spare long, sketch binary, a long, b long, bucket long, nodes binary, sets long, times long"


def _found(count: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(count, f.type) for f in _FOUND], schema=_FOUND)


def _distinct(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Positions of the different pairs, in order."""
    order = np.lexsort((second, first))
    x, y = first[order], second[order]
    return order[np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])] if len(order) else order


def bucket_pairs(pairs: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, int]]]:
    """Candidates (n x 2) of packed (sig, node) pairs, and the different buckets of more than STAR sets by a key of their nodes: these and how often they occur."""
    pairs = pairs[_distinct(pairs["sig"], pairs["node"])]
    new = np.concatenate([[True], pairs["sig"][1:] != pairs["sig"][:-1]]) if len(pairs) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    size = np.diff(np.concatenate([start, [len(pairs)]]))
    keep = np.repeat(size > 1, size)
    node, first, width = pairs["node"][keep], np.repeat(start, size)[keep], np.repeat(size, size)[keep]
    out = [np.stack([pairs["node"][first], node], axis=1)]
    for d in range(1, min(STAR, len(node))):
        near = (first[d:] == first[:-d]) & (width[d:] <= STAR)
        out.append(np.stack([node[:-d][near], node[d:][near]], axis=1))
    found = np.concatenate(out)
    found = found[found[:, 0] != found[:, 1]]
    found = found[_distinct(found[:, 0], found[:, 1])]
    large: dict[int, tuple[np.ndarray, int]] = {}
    for s, n in zip(start[size > STAR], size[size > STAR], strict=True):
        nodes = np.ascontiguousarray(pairs["node"][s : s + n])
        key = xxhash.xxh3_64_intdigest(nodes) - (1 << 63)
        large[key] = (nodes, large.get(key, (None, 0))[1] + 1)
    return found, large


def _bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    blocks: dict[int, list[bytes]] = {}
    for batch in batches:
        has = batch.column("block").is_valid()
        for part, block in zip(*(batch.column(x).filter(has) for x in ("part", "block")), strict=True):
            blocks.setdefault(part.as_py(), []).append(block.as_py())
        rest = batch.filter(pa.compute.invert(has))
        if len(rest):
            yield _found(len(rest), **{x: rest.column(x) for x in ("doc_id", "row", "node", "size", "spare", "sketch")})
    for part in list(blocks):  # no signature is in two parts
        found, large = bucket_pairs(np.frombuffer(b"".join(blocks.pop(part)), dtype=_PAIR))
        for lo in range(0, len(found), 20_000):
            x = found[lo : lo + 20_000]
            yield _found(len(x), a=pa.array(x[:, 0]), b=pa.array(x[:, 1]))
        cut = [(key, nodes[lo : lo + ROW].tobytes(), len(nodes), times) for key, (nodes, times) in large.items() for lo in range(0, len(nodes), ROW)]
        for lo in range(0, len(cut), 10_000):
            keys, raw, sets, times = zip(*cut[lo : lo + 10_000], strict=True)
            yield from slices(_found(len(keys), bucket=pa.array(keys, pa.int64()), nodes=pa.array(raw, pa.binary()), sets=pa.array(sets, pa.int64()), times=pa.array(times, pa.int64())))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingles(x.as_py()).tobytes() for x in batch.column("text")]
        yield from slices(pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.binary())], names=["node", "shingles"]))


@F.pandas_udf(T.BooleanType())
def _similar(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([similar(np.frombuffer(x, dtype=U), np.frombuffer(y, dtype=U)) for x, y in zip(left, right, strict=True)], dtype=bool)


@F.pandas_udf(T.BooleanType())
def _possible(left: pd.Series, right: pd.Series, left_size: pd.Series, right_size: pd.Series) -> pd.Series:
    def test(x, y, n, m) -> bool:
        if 5 * min(n, m) < 4 * max(n, m):
            return False
        a, b = _counts([x, y])
        return 9 * int(np.abs(a - b).sum()) <= n + m

    return pd.Series([test(*x) for x in zip(left, right, left_size, right_size, strict=True)], dtype=bool)


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label with the labels of a[i] and b[i] joined for each i: the least label of all that are connected."""
    names, at = np.unique(label, return_inverse=True)
    least, x, y = np.arange(len(names)), at[a], at[b]
    while True:
        low = np.minimum(least[x], least[y])
        new = least.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == least).all():
            return names[least[at]]
        least = new


def possible_components(left: np.ndarray, right: np.ndarray, size: np.ndarray, counts: np.ndarray, component: np.ndarray) -> np.ndarray:
    """component with those joined that hold a pair of positions of left and right whose sketches leave it possible."""
    label = component
    coarse = counts.reshape(len(counts), 16, -1).sum(axis=2, dtype=np.int16)  # a weaker bound for a first look
    step = max(1, (1 << 21) // max(1, len(right) * 16))
    for lo in range(0, len(left), step):
        part = left[lo : lo + step]
        near = label[part][:, None] != label[right][None, :]
        if not near.any():
            continue
        near &= 9 * np.abs(coarse[part][:, None, :] - coarse[right][None, :, :]).sum(axis=2, dtype=np.int32) <= size[part][:, None] + size[right][None, :]
        rows, cols = np.nonzero(near)
        for at in range(0, len(rows), 1 << 14):
            i, j = part[rows[at : at + (1 << 14)]], right[cols[at : at + (1 << 14)]]
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
            good = 9 * np.abs(counts[i] - counts[j]).sum(axis=1, dtype=np.int32) <= size[i] + size[j]
            if good.any():
                label = _joined(label, i[good], j[good])
    return label


def similar_components(left: np.ndarray, right: np.ndarray, sets: list[np.ndarray], component: np.ndarray) -> np.ndarray:
    """component with those joined that hold a similar pair of positions of left and right."""
    size, label = np.array([len(x) for x in sets]), component.copy()
    if not len(left) or not len(right):
        return label
    bits = max(16, min(24, int(size.max()).bit_length() + 9))
    keys = [(sets[j] >> U(64 - bits)).astype(np.int32) for j in right]
    every, starts = np.concatenate(keys), np.concatenate([[0], np.cumsum(size[right])])
    seen, first = np.zeros(1 << bits, dtype=bool), np.zeros(len(sets), dtype=bool)
    first[left] = True
    for i in left:
        near = (label[right] != label[i]) & (5 * np.minimum(size[right], size[i]) >= 4 * np.maximum(size[right], size[i]))
        near &= ~first[right] | (right > i)  # of two positions on both sides, once is enough
        if not near.any():
            continue
        mine = (sets[i] >> U(64 - bits)).astype(np.int32)
        seen[mine] = True
        if 4 * near.sum() > len(near):
            both = np.add.reduceat(seen[every], starts[:-1], dtype=np.int32)  # at least the shared shingles; no set is empty
            near = np.flatnonzero(near & (9 * both >= 4 * (size[right] + size[i])))
        else:
            near = np.flatnonzero(near)
            near = near[[9 * int(seen[keys[k]].sum()) >= 4 * (size[right[k]] + size[i]) for k in near]]
        seen[mine] = False
        for j in right[near]:
            if label[i] != label[j] and similar(sets[i], sets[j]):
                x, y = label[i], label[j]
                label[label == max(x, y)] = min(x, y)
    return label


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have at least 80 of 100 elements of their union in common."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < 80 * len(b):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= 80 * (len(a) + len(b) - both)


BOTH, LEFT, RIGHT = 0, 1, 2


def _by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each task of a partition, which is sorted by task."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        task = batch.column("task").to_numpy()
        ends = [*(np.flatnonzero(task[1:] != task[:-1]) + 1).tolist(), len(task)]
        if held and len(task) and held[-1].column("task")[0].as_py() != task[0]:
            yield pa.Table.from_batches(held)
            held = []
        for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
            if hi > lo:
                held.append(batch.slice(lo, hi - lo))
            if hi < len(task):
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _joins(exact: bool):
    """(a, b): for each task the components that it joined, each with the least one joined to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_task(batches):
            role, old = table["role"].to_numpy(), table["component"].to_numpy()
            left, right = np.flatnonzero(role != RIGHT), np.flatnonzero(role != LEFT)
            if exact:
                new = similar_components(left, right, [np.frombuffer(x.as_py(), dtype=U) for x in table["shingles"]], old)
            else:
                new = possible_components(left, right, table["size"].to_numpy(), _counts(table["sketch"].to_pylist()), old)
            pairs = np.unique(np.stack([old, new], axis=1)[old != new], axis=0)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def _unpacked(buckets: DataFrame) -> DataFrame:
    """(bucket, node, sets, times): members of the different buckets, the sets in them and the signatures that made them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = [np.frombuffer(x.as_py(), dtype="<i8") for x in batch.column("nodes")]
            if nodes:
                count = [len(x) for x in nodes]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("bucket").to_numpy(), count)), pa.array(np.concatenate(nodes)), *(pa.array(np.repeat(batch.column(x).to_numpy(), count)) for x in ("sets", "times"))], names=["bucket", "node", "sets", "times"])

    rows = buckets.mapInArrow(run, "bucket long, node long, sets long, times long")
    return rows.groupBy("bucket", "node", "sets").agg(F.sum("times").alias("times"))


def _needed(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members without the places in the largest buckets that each set can do without."""
    largest = Window.partitionBy("node").orderBy(F.col("sets").desc(), "bucket")
    rows = members.withColumn("upto", F.sum("times").over(largest)).join(nodes.select("node", "spare"), "node")
    return rows.where("upto > spare").select("bucket", "node")


def _sets_of(used: DataFrame, keyed: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles) of the nodes in used, without repeats. The sets are made anew from the texts, one of each node."""
    wanted = stored(nodes.join(used, "node", "left_semi").select(F.col("row").alias("r"), "node"), "ngram-used")
    texts = keyed.join(small_or_not(wanted), F.col("row") == F.col("r")).select("node", "text")
    sets = stored(texts.mapInArrow(_sets, "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles")), "ngram-sets")
    drop_stored(wanted)
    return sets


def _verified(pairs: DataFrame, keyed: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    sets = _sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), keyed, nodes)
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    links = stored(both.where(_similar("x", "y")).select("a", "b"), "ngram-links")
    drop_stored(sets)
    return links


def _dealt(rows: DataFrame, by: str, weight, most: int, kind) -> DataFrame:
    """rows with task and role: the pairs of every `by` between different components, in tasks of at most about two blocks of this weight.

    Up to `most` it is one task. Beyond, its largest component is kind 0, if it is more than a block itself, and the other members have the kind given (from 1 on); members meet those of their own kind and the next one, and of kind 0,
    which does not meet itself. Only a member of a large one is copied, once for each block that it meets.
    """
    sums = stored(rows.groupBy(by).agg(F.sum(weight).alias("sum")).where(F.col("sum") > most).select(F.col(by).alias("g")), "ngram-large")
    marked = rows.join(small_or_not(sums), F.col(by) == F.col("g"), "left")
    small = marked.where("g is null").drop("g").select("*", F.col(by).alias("task"), F.lit(BOTH).alias("role"))
    large = marked.where("g is not null").drop("g")
    parts = large.groupBy(by, "component").agg(F.sum(weight).alias("sum")).groupBy(F.col(by).alias("g")).agg(F.max_by("component", "sum").alias("main"), F.max("sum").alias("sum"))
    parts = small_or_not(stored(parts.where(F.col("sum") > most).drop("sum"), "ngram-main"))
    kinds = F.when(F.col("component") == F.col("main"), F.lit(0)).otherwise(kind).cast("int")
    large = large.join(parts, F.col(by) == F.col("g"), "left").withColumn("kind", kinds).drop("g", "main")
    n = F.greatest(F.lit(1), F.ceil(F.sum(weight) / most)).cast("long")
    blocks = stored(large.groupBy(F.col(by).alias("g"), F.col("kind").alias("k")).agg(n.alias("n")), "ngram-blocks")
    there = blocks.select(F.col("g").alias("g2"), F.col("k").alias("k2"), F.col("n").alias("n2"))
    meets = F.when(F.col("k") == 0, F.col("k2") > 0).otherwise((F.col("k2") == F.col("k")) | (F.col("k2") == F.col("k") + 1))
    tasks = stored(blocks.join(there, (F.col("g") == F.col("g2")) & meets).drop("g2"), "ngram-tasks")
    block = lambda count: F.pmod(F.xxhash64("node"), F.col(count))
    upto = lambda lo, hi: F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))
    same, zero = F.col("k") == F.col("k2"), F.lit(0).cast("long")
    task = F.xxhash64("g", "k", "i", "k2", "j").alias("task")
    to = small_or_not(tasks)
    left = large.join(to, (F.col(by) == F.col("g")) & (F.col("kind") == F.col("k"))).withColumn("i", block("n"))
    left = left.withColumn("j", F.explode(upto(F.when(same, F.col("i")).otherwise(zero), F.col("n2") - 1)))
    left = left.select(*rows.columns, task, F.when(same & (F.col("i") == F.col("j")), BOTH).otherwise(LEFT).alias("role"))
    right = large.join(to, (F.col(by) == F.col("g")) & (F.col("kind") == F.col("k2"))).withColumn("j", block("n2"))
    right = right.withColumn("i", F.explode(upto(zero, F.when(same, F.col("j")).otherwise(F.col("n")) - 1))).select(*rows.columns, task, F.lit(RIGHT).alias("role"))
    return small.unionByName(left).unionByName(right)


def _merged(dealt: DataFrame, exact: bool, parts: int) -> DataFrame:
    """(component, into): the least component that each one is joined to over all tasks."""
    edges = dealt.repartition(parts, "task").sortWithinPartitions("task").mapInArrow(_joins(exact), "a long, b long")
    found = connected_components(stored(edges.distinct(), "ngram-edges"))
    return stored(found.select(F.col("node").alias("c"), F.col("component").alias("into")), "ngram-into")


def similar_groups(docs: DataFrame) -> DataFrame:
    """doc_id, row (a key of the row's content), node (of its set), n_shingles, component_id of each row of docs (doc_id, text)."""
    parts = partitions(docs.sparkSession, docs)
    keyed = docs.select(F.col("doc_id").cast("long"), row_key("doc_id", "text").alias("row"), "text")
    dealt = keyed.mapInArrow(_signed(4 * parts), _OUT_SQL).repartition(parts, "part")
    found = stored(dealt.mapInArrow(_bucketed, _FOUND_SQL), "ngram-found")
    rows = found.where("row is not null").select("doc_id", "row", "node", "size")
    whole = found.where("row is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.min("row").alias("row"), F.first("size").alias("size"), F.first("spare").alias("spare"), F.first("sketch").alias("sketch"))
    nodes = stored(whole, "ngram-nodes")
    side = lambda k: nodes.select(F.col("node").alias(k), F.col("size").alias(f"size_{k}"), F.col("sketch").alias(f"sketch_{k}"))
    pairs = found.where("a is not null").select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")
    tried = stored(pairs.where(_possible("sketch_a", "sketch_b", "size_a", "size_b")).select("a", "b"), "ngram-pairs")
    component = stored(connected_components(_verified(tried, keyed, nodes)), "ngram-components")
    known = stored(nodes.join(component, "node", "left").select("node", "row", "least", "size", "sketch", F.coalesce("component", "node").alias("component")), "ngram-known")

    # Large buckets of more than one component: which components could be linked.
    members = _needed(_unpacked(found.where("bucket is not null").select("bucket", "nodes", "sets", "times")), nodes)
    inside = stored(members.join(known.select("node", "component"), "node"), "ngram-inside")
    mixed = inside.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
    several = stored(inside.join(mixed, "bucket", "left_semi").join(known.select("node", "size", "sketch"), "node"), "ngram-mixed")
    band = 1 + F.floor(F.log(F.col("size")) / F.log(F.lit(1.25)))
    possible = _merged(_dealt(several, "bucket", F.lit(1), BLOCK, band), exact=False, parts=parts)
    drop_stored(inside, several)

    # Groups of them: which are.
    groups = possible.withColumnRenamed("into", "g")
    grouped = stored(known.join(small_or_not(groups), F.col("component") == F.col("c")).select("node", "size", "component", F.col("g").alias("bucket")), "ngram-groups")
    sets = _sets_of(grouped.select("node"), keyed, nodes)
    close = _merged(_dealt(grouped, "bucket", F.col("size"), SHINGLES, F.lit(1)).join(sets, "node"), exact=True, parts=parts)

    joined = known.join(small_or_not(close), F.col("component") == F.col("c"), "left").select("node", "least", F.coalesce("into", "component").alias("component"))
    least = stored(joined.groupBy("component").agg(F.min("least").alias("component_id")), "ngram-least")
    named = stored(joined.join(least, "component").select(F.col("node").alias("m"), "component_id"), "ngram-named")
    drop_stored(nodes, tried, component, known, possible, grouped, sets, close, least)
    out = rows.join(small_or_not(named), F.col("node") == F.col("m"), "left")
    component_id = F.when(F.col("size") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "row", "node", F.col("size").alias("n_shingles"), component_id.alias("component_id"))


def keep_one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of docs without words, and of every group of linked documents one row with the least doc_id, with the columns of docs."""
    groups = stored(similar_groups(docs), "ngram-groups")
    full = groups.where("n_shingles > 0")
    # The least id, then the least content; repeated rows are one.
    best = full.groupBy("component_id").agg(F.min_by("row", F.struct(F.coalesce((F.col("doc_id") != F.col("component_id")).cast("int"), F.lit(1)), "row")).alias("r"))
    copies = full.groupBy("row").agg(F.count("*").alias("copies"))
    best = best.join(copies, F.col("r") == F.col("row")).select("r", "copies")
    empty = groups.where("n_shingles = 0").select(F.col("row").alias("r"), F.lit(1).cast("long").alias("copies")).distinct()
    chosen = stored(best.unionByName(empty), "ngram-chosen")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, row_key("doc_id", "text").alias("k")).join(chosen.hint("merge"), F.col("k") == F.col("r"))
    once = keyed.where("copies = 1").select("row")
    return once.unionByName(keyed.where("copies > 1").dropDuplicates(["k"]).select("row")).select("row.*")
