"""Packing documents into sequences by a grouping genetic algorithm on islands.

Only a document longer than a sequence is cut, into full pieces and one remainder, which comes first. Full pieces are sequences already. All other pieces are dealt at random to
shards of about SHARD pieces. On each shard several islands evolve a population of packings: a crossover injects whole well-filled bins of one parent into the other, drops the bins that
held the same pieces, and best-fits the pieces displaced. The best packing is then refilled: the emptiest bins and some others give up their pieces, and each bin is filled again
by the subset of them that fills it most, as long as bins get fewer or less even. Between epochs the best packing of each island migrates to the next island of its shard. An epoch of one island is
one task of bounded size; a lost one is computed again from its shard, with the same random numbers. A shard stops at its lower bound.

Defined results: a null or empty text is one piece with the end token alone; repeated rows are documents of their own; an empty table gives an empty table; columns beside
doc_id and text do not matter.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codec import default_path, encoder
from .shared import stored

LENGTH, END, SHARD = 1024, 2, 4096
#: What an island may spend in an epoch; one that meets the lower bound stops at once.
ISLANDS, EPOCHS, POPULATION, GENERATIONS, KEEP, REFILLS = 2, 2, 5, 16, 0.6, 600

Packing = list[list[int]]


def fills(packing: Packing, sizes) -> list[int]:
    return [sum(map(sizes.__getitem__, b)) for b in packing]


def best_fit(order, sizes, length: int, packing: Packing) -> Packing:
    """Put each piece of order into the fullest bin that still holds it, or into a new one. Changes packing."""
    room = sorted((length - n, k) for k, n in enumerate(fills(packing, sizes)))
    for i in order:
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            left, k = room.pop(at)
            packing[k].append(i)
        else:
            left, k = length, len(packing)
            packing.append([i])
        if left > sizes[i]:
            insort(room, (left - sizes[i], k))
    return packing


def fitness(packing: Packing, sizes, length: int) -> tuple[int, float]:
    """Fewer bins first; among equals, rather full and empty ones than even ones."""
    return -len(packing), sum((n / length) ** 2 for n in fills(packing, sizes)) / max(1, len(packing))


def crossover(giver: Packing, taker: Packing, sizes, length: int, rng) -> Packing:
    """Inject a random share of the giver's well-filled bins into the taker, drop its bins that hold the same pieces, best-fit what they displace."""
    good = [b for b, n in zip(giver, fills(giver, sizes), strict=True) if n >= 0.98 * length] or giver
    injected = [list(good[k]) for k in rng.choice(len(good), max(1, int(len(good) * KEEP * rng.random())), replace=False)]
    inside = {i for b in injected for i in b}
    child, loose = injected, []
    for b, n in zip(taker, fills(taker, sizes), strict=True):
        if not inside.isdisjoint(b):
            loose += [i for i in b if i not in inside]
        elif n >= 0.9 * length:
            child.append(list(b))
        else:  # ill-filled bins are displaced too
            loose += b
    return best_fit(sorted(loose, key=lambda i: -sizes[i]), sizes, length, child)


def fullest(room: int, pieces: list[int], sizes) -> list[int]:
    """Of pieces, largest first, a subset that leaves least of room; earlier pieces are preferred. Bit n of a mask says that a sum of n is reached."""
    most, masks = (2 << room) - 1, [1]
    for i in pieces:
        masks.append((masks[-1] | masks[-1] << sizes[i]) & most)
        if masks[-1] >> room:
            break
    left, chosen = masks[-1].bit_length() - 1, []
    for k in range(len(masks) - 2, -1, -1):
        if not masks[k] >> left & 1:
            chosen.append(pieces[k])
            left -= sizes[pieces[k]]
    return chosen


def refill(packing: Packing, sizes, length: int, rng, tries: int) -> Packing:
    """Fill some bins again, the emptiest ones among them, and keep what is no less fit, until the lower bound or so many tries."""
    bins = [list(b) for b in packing]
    filled = fills(bins, sizes)
    least = -(-sum(filled) // length)
    emptiest = np.argsort(filled, kind="stable")[:3].tolist()
    for _ in range(tries):
        if len(bins) <= least:
            break
        some = min(len(bins), int(rng.integers(5, 40)))
        open_ = sorted({*emptiest, *rng.integers(0, len(bins), some).tolist()}, reverse=True)
        rest = sorted((i for k in open_ for i in bins[k]), key=lambda i: -sizes[i])
        new = []
        while rest:
            new.append([rest[0], *fullest(length - sizes[rest[0]], rest[1:], sizes)])
            rest = [i for i in rest if i not in new[-1]]
        sums = fills(new, sizes)
        square = lambda xs: sum(x * x for x in xs)
        if len(new) < len(open_) or (len(new) == len(open_) and square(sums) >= square(filled[k] for k in open_)):
            for k in open_:
                bins[k], filled[k] = bins[-1], filled[-1]
                bins.pop()
                filled.pop()
            bins += new
            filled += sums
            emptiest = np.argsort(filled, kind="stable")[:3].tolist()
    return bins


def evolve(sizes, length: int, seed: int, immigrants: list[Packing], population: int = POPULATION, generations: int = GENERATIONS) -> Packing:
    """The best packing that one island finds in one epoch."""
    rng = np.random.default_rng(seed)
    least = -(-int(sum(sizes)) // length)
    people = [p for p in immigrants if p]
    while len(people) < population:
        noise = rng.normal(0, 0 if not people else 0.15, len(sizes))
        people.append(best_fit(np.argsort(-(np.asarray(sizes) * (1 + noise)), kind="stable").tolist(), sizes, length, []))
        if len(people[-1]) == least:
            return people[-1]
    ranked = sorted(((fitness(p, sizes, length), p) for p in people), key=lambda x: x[0], reverse=True)
    for _ in range(generations):
        if len(ranked[0][1]) == least:
            break
        a, b = rng.choice(len(ranked), 2, replace=False)
        child = crossover(ranked[a][1], ranked[b][1], sizes, length, rng)
        ranked.append((fitness(child, sizes, length), child))
        ranked.sort(key=lambda x: x[0], reverse=True)
        ranked.pop()
    return refill(ranked[0][1], sizes, length, rng, REFILLS * SHARD // max(len(sizes), SHARD // 4))


def pieces_of(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each row of docs."""

    @F.pandas_udf("lengths array<bigint>, crcs array<bigint>")
    def cut(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encode = encoder(path)
        for texts in parts:
            lengths, crcs = [], []
            for text in texts:
                ids = np.append(encode(text), np.uint32(END)).astype("<u4").tobytes()
                ends = range((len(ids) // 4 - 1) % length + 1, len(ids) // 4 + 1, length)
                lengths.append([ends[0], *[length] * (len(ends) - 1)])
                crcs.append([zlib.crc32(ids[max(0, 4 * (e - length)) : 4 * e]) for e in ends])
            yield pd.DataFrame({"lengths": lengths, "crcs": crcs})

    rows = docs.select("doc_id", cut(F.coalesce("text", F.lit(""))).alias("cut"))
    rows = rows.select("doc_id", F.element_at("cut.lengths", 1).alias("first"), F.posexplode(F.arrays_zip("cut.lengths", "cut.crcs")).alias("piece", "x"))
    start = F.when(F.col("piece") == 0, 0).otherwise(F.col("first") + (F.col("piece") - 1) * length).cast("long")
    return rows.select("doc_id", "piece", start.alias("start"), F.col("x.lengths").alias("length"), F.col("x.crcs").alias("ids_crc32"))


def _genes(packing: Packing, count: int) -> bytes:
    bins = np.zeros(count, dtype="<u4")
    for k, b in enumerate(packing):
        bins[b] = k
    return zlib.compress(bins.tobytes(), 1)


def _packing(genes: bytes) -> Packing:
    bins = np.frombuffer(zlib.decompress(genes), dtype="<u4")
    order = np.argsort(bins, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(bins[order])) + 1)]


def _epoch(number: int, length: int):
    """One epoch of one island: its pieces have a uid, its immigrants have genes."""

    def run(keys, pdf: pd.DataFrame) -> pd.DataFrame:
        pieces = pdf[pdf["genes"].isna()].sort_values("uid")
        immigrants = [_packing(g) for g in pdf["genes"].dropna()]
        best = evolve(pieces["length"].tolist(), length, [int(keys[0]), int(keys[1]), number], immigrants)
        return pd.DataFrame({"shard": [keys[0]], "island": [keys[1]], "bins": [len(best)], "genes": [_genes(best, len(pieces))]})

    return run


def _placed(length: int):
    """The pieces of a shard with their place in the best packing of its islands."""

    def run(keys, pdf: pd.DataFrame) -> pd.DataFrame:
        pieces = pdf[pdf["genes"].isna()].sort_values("uid").reset_index(drop=True)
        sizes = pieces["length"].tolist()
        best = max((_packing(g) for g in pdf["genes"].dropna()), key=lambda p: fitness(p, sizes, length))
        bins, offsets = np.zeros(len(sizes), dtype="int64"), np.zeros(len(sizes), dtype="int64")
        for k, b in enumerate(best):
            bins[b], offsets[b] = k, np.cumsum([0, *(sizes[i] for i in b[:-1])])
        return pd.DataFrame({"uid": pieces["uid"], "sequence_id": (int(keys[0]) << 32) + bins, "offset": offsets})

    return run


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece of docs (doc_id, text)."""
    pieces = stored(pieces_of(docs, path or default_path(), length).withColumn("uid", F.monotonically_increasing_id()), "pack-pieces")
    loose = pieces.where(F.col("length") < length)
    shards = max(1, round(loose.count() / shard))
    members = loose.select(F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("long").alias("shard"), "uid", F.col("length").cast("long"), F.lit(None).cast("binary").alias("genes"))
    every = members.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))

    def arrivals(best: DataFrame, to) -> DataFrame:
        return best.select("shard", F.lit(-1).cast("long").alias("uid"), F.lit(0).cast("long").alias("length"), "genes", to.cast("int").alias("island"))

    best = None
    for number in range(EPOCHS):
        rows = every
        if best is not None:  # the elite of each island stays and also migrates to the next one
            rows = rows.unionByName(arrivals(best, F.col("island"))).unionByName(arrivals(best, (F.col("island") + 1) % ISLANDS))
        best = stored(rows.groupBy("shard", "island").applyInPandas(_epoch(number, length), "shard long, island int, bins long, genes binary"), "pack-elite")
    rows = members.unionByName(best.select("shard", F.lit(-1).cast("long").alias("uid"), F.lit(0).cast("long").alias("length"), "genes"))
    placed = rows.groupBy("shard").applyInPandas(_placed(length), "uid long, sequence_id long, offset long").withColumnRenamed("uid", "u")
    placed = loose.join(placed, F.col("uid") == F.col("u")).drop("u")
    full = pieces.where(F.col("length") == length).withColumn("sequence_id", -1 - F.col("uid")).withColumn("offset", F.lit(0).cast("long"))
    return placed.unionByName(full).drop("uid")
