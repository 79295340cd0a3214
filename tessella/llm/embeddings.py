"""Near-duplicate vectors by an exact metric range join.

Equal vectors of one label are one class, told apart by a 64-bit hash. A bounded sample of classes gives pivots; each class has its home in the cell of the nearest pivot. Cosine >= c is a chord of at most
T = sqrt(2 - 2c) between unit vectors, so by the triangle inequality a vector v can be that near a vector with home in cell j only if d(v, p_j) <= d(v, p_home) + 2T; for chords the distance to the plane between
both pivots gives the sharper (d(v, p_j)^2 - d(v, p_home)^2) / (2 d(p_home, p_j)) <= T. Where both hold, v is copied to the cell. Cells join independently, large ones in blocks of at most
BLOCK x BLOCK, so that a task is bounded whatever the cell holds. A block returns a row for each class: the number of vectors linked, and the least class of its local component. No pairs are written.

Defined results: rows with a null label link with nothing; nor do vectors that are null, empty or zero or hold null or non-finite components; vectors of different length never link; repeated rows are vectors of their own that link with
each other; a null vec_id counts as larger than all others; an empty table gives an empty table; other columns do not matter.
"""

from __future__ import annotations

from math import ceil, fsum, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .shared import small_or_not, stored

COSINE, BLOCK = 0.98, 2000
#: Pivots: the square root of an average label's classes by CELL, as a vector near many bounds is copied to many cells. Their number is bounded by what a plan may hold (4 MB of 64 dimensions), at 1.7 thousand million classes a label.
CELL, MOST_PIVOTS = 25, 8192


def _scaled(vectors) -> np.ndarray:
    """Vectors as rows, each by the power of two that makes its largest component about 1: no square under- or overflows, and no digit changes."""
    x = np.stack([np.asarray(v, dtype="float64") for v in vectors])
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def _unit(vectors) -> np.ndarray:
    x = _scaled(vectors)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _cells(pivots: dict[int, np.ndarray], reach: float):
    """Home cell of each vector and the cells that need a copy of it."""

    @F.pandas_udf("home int, copies array<int>")
    def assigned(vectors: pd.Series) -> pd.DataFrame:
        home, copies = np.zeros(len(vectors), dtype="int32"), [[] for _ in range(len(vectors))]
        sizes = vectors.map(len).to_numpy() if len(vectors) else np.zeros(0, int)
        for dim in set(sizes.tolist()) & set(pivots):
            at, p = np.flatnonzero(sizes == dim), pivots[dim]
            d = np.sqrt(np.maximum(0, 2 - 2 * _unit(vectors.iloc[at]) @ p.T))
            near = d.argmin(axis=1)
            own = d[np.arange(len(at)), near][:, None]
            apart = np.sqrt(np.maximum(0, 2 - 2 * p @ p.T))[near]
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = np.where(apart > 0, (d * d - own * own) / (2 * apart), 0)
            need = (d <= own + 2 * reach) & (plane <= reach)
            need[np.arange(len(at)), near] = False
            home[at] = near
            for i, row in zip(at, need, strict=True):
                copies[i] = np.flatnonzero(row).tolist()
        return pd.DataFrame({"home": home, "copies": copies})

    return assigned


def linked_block(ids_a, a: np.ndarray, ids_b, b: np.ndarray, weight, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each a: the weight of the b's linked; and the least id of the component in the block, for each a and each b."""
    norm_a, norm_b = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    cos = (a @ b.T) / (norm_a[:, None] * norm_b[None, :])
    links = cos >= cosine
    for i, j in zip(*np.nonzero(np.abs(cos - cosine) < 1e-12), strict=True):  # near the bound, sum without rounding
        x, y = a[i].tolist(), b[j].tolist()
        links[i, j] = fsum(p * q for p, q in zip(x, y, strict=True)) / (sqrt(fsum(p * p for p in x)) * sqrt(fsum(q * q for q in y))) >= cosine
    links &= ids_a[:, None] != ids_b[None, :]
    label_a, label_b = ids_a.copy(), ids_b.copy()
    rows, cols = links.any(axis=1), links.any(axis=0)
    if rows.any():
        part, la, lb, top = links[np.ix_(rows, cols)], ids_a[rows], ids_b[cols], np.iinfo("int64").max
        while True:
            na = np.minimum(la, np.where(part, lb[None, :], top).min(axis=1))
            nb = np.minimum(lb, np.where(part, na[:, None], top).min(axis=0))
            if (na == la).all() and (nb == lb).all():
                break
            la, lb = na, nb
        label_a[rows], label_b[cols] = la, lb
    return links @ weight, label_a, label_b


def _block_join(cosine: float):
    def run(keys, pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["left"]], pdf[~pdf["left"]]
        if not len(left) or not len(right):
            return pd.DataFrame({"k": [], "links": [], "other": []}).astype("int64")
        stack = lambda x: _scaled(x["v"])
        ia, ib = left["k"].to_numpy(), right["k"].to_numpy()
        counts, la, lb = linked_block(ia, stack(left), ib, stack(right), right["n"].to_numpy(), cosine)
        a, b = (la != ia) | (counts > 0), lb != ib
        return pd.DataFrame({"k": np.concatenate([ia[a], ib[b]]), "links": np.concatenate([counts[a], np.zeros(b.sum(), "int64")]), "other": np.concatenate([la[a], lb[b]])})

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK, cell: int = CELL) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of vectors (vec_id, embedding, label)."""
    reach = sqrt(max(0.0, 2 - 2 * cosine)) + 1e-7
    e = F.col("embedding")
    sound = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    key = F.when(F.coalesce(sound & F.col("label").isNotNull(), F.lit(False)), F.xxhash64("label", e))
    keyed = vectors.select("vec_id", key.alias("k"), "label", e.alias("v"))
    classes = keyed.where("k is not null").groupBy("k", "label", "v").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    classes = stored(classes.withColumn("dim", F.size("v")), "vec-classes")
    total, groups = classes.agg(F.count("*"), F.count_distinct("label")).first()
    wanted = min(MOST_PIVOTS, ceil(sqrt(total / (cell * max(1, groups)))))
    sample = classes.orderBy(F.xxhash64("k", F.lit(1))).limit(wanted).select("v").collect() if total else []
    pivots = {d: _unit([r.v for r in sample if len(r.v) == d]) for d in {len(r.v) for r in sample}}
    placed = stored(classes.withColumn("at", _cells(pivots, reach)("v")).select("k", "label", "dim", "v", "n", "at.home", "at.copies"), "vec-cells")
    group = ["label", "dim", "cell"]
    every = placed.select("k", "label", "dim", "v", "n", F.explode(F.concat(F.array("home"), "copies")).alias("cell"), "home")
    counts = every.groupBy(*group).agg(F.ceil(F.count("*") / block).alias("n_b"), F.greatest(F.lit(1), F.ceil(F.sum((F.col("home") == F.col("cell")).cast("long")) / block)).alias("n_a"))
    every = every.join(small_or_not(stored(counts, "vec-counts")), group)
    part = lambda n: F.pmod(F.xxhash64("k", F.lit(2)), n)
    fields = ["k", "v", "n", *group]
    homes = every.where("home = cell").select(*fields, F.lit(True).alias("left"), part(F.col("n_a")).alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_b") - 1)).alias("b"))
    others = every.select(*fields, F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_a") - 1)).alias("a"), part(F.col("n_b")).alias("b"))
    joined = homes.unionByName(others).groupBy(*group, "a", "b").applyInPandas(_block_join(cosine), "k long, links long, other long")
    found = stored(joined, "vec-links")
    component = connected_components(found.select(F.col("k").alias("a"), F.col("other").alias("b")))
    result = classes.select("k", "n", "least").join(found.groupBy("k").agg(F.sum("links").alias("links")), "k", "left")
    result = stored(result.join(component, F.col("k") == F.col("node"), "left").select("k", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "k").alias("component"), "least"), "vec-result")
    least = result.groupBy("component").agg(F.min("least").alias("component_id"))
    result = stored(result.join(least, "component").select(F.col("k").alias("ck"), "n_links", "component_id"), "vec-joined")
    rows = keyed.select("vec_id", "k").join(small_or_not(result), F.col("k") == F.col("ck"), "left")
    component_id = F.coalesce("component_id", "vec_id")
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), F.coalesce(F.col("vec_id") == component_id, F.lit(False)).alias("kept"))
