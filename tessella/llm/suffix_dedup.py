"""Removal of byte strings that repeat anywhere in the corpus, by suffix arrays.

Every string of LENGTH bytes belongs to the least hashed gram of half its length inside it, the leftmost one among equals. That choice depends on the string alone, so equal strings belong to equal grams, and shards by gram
are independent. Consecutive strings of one gram are one context of at most 1.5 * LENGTH bytes.

1. Each batch of texts sends the hashes of its contexts, packed, to the shards of their grams. Contexts that occur twice are covered whole. A gram with different contexts needs their bytes, one
   copy of each.
2. A shard concatenates these contexts, sorts their suffixes by induced sorting (induced.py), and takes the permuted common prefixes: strings whose common prefix with a neighbour in order has LENGTH bytes or more repeat.
3. Each text drops the bytes covered by its repeated strings, all judged on the input.

Two lengths are at work. PASSAGE finds passages of more than 50 words (words of the corpus have five letters and a space, and 50 of them 254 bytes or more); it is what drop_repeats() cuts, and what the column n_repeated of removed_repeats()
counts. A string of LENGTH bytes that repeats lies within a run that strings of PASSAGE bytes cover, there and elsewhere, so only these runs are searched again for what removed_repeats() removes.

Contexts are told apart by two 64-bit hashes. Defined results: a null text is the empty one; repeated rows repeat each other; a text shorter than LENGTH is left as it is; an
empty table gives an empty table; columns beside doc_id and text do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import U, Ranges, mix, odd
from .induced import common_prefixes, suffix_array
from .shared import drop_stored, partitions, row_key, slices, stored

LENGTH, PASSAGE, BATCH, SORTED = 400, 250, 1 << 19, 1 << 19
_CONTEXT = np.dtype([("gram", "<u8"), ("hash", "<u8"), ("row", "<i8"), ("start", "<u4"), ("more", "<u2"), ("lead", "<u2")])


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of x[i : i + width] for each i."""
    n = len(x) - width + 1
    padded = np.concatenate([x, np.full(-len(x) % width, np.iinfo(x.dtype).max, dtype=x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def contexts(texts: list[bytes], rows, length: int = LENGTH) -> np.ndarray:
    """The contexts of some texts: starts of their first strings, and by how many more bytes the last one starts later."""
    half = length // 2
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    if len(raw) < length:
        return np.zeros(0, dtype=_CONTEXT)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    ranges = Ranges(raw)
    grams = ranges.every(half)
    bits = U(max(1, int(len(grams)).bit_length()))
    key = (grams >> bits << bits) | np.arange(len(grams), dtype=U)
    chosen = (_sliding_least(key, length - half + 1) & ((U(1) << bits) - U(1))).astype(np.int64)
    text_of = np.repeat(np.arange(len(texts)), np.maximum(0, sizes - length + 1))
    at = np.arange(len(text_of)) + np.repeat(ends - sizes - np.concatenate([[0], np.cumsum(np.maximum(0, sizes - length + 1))[:-1]]), np.maximum(0, sizes - length + 1))
    if not len(at):
        return np.zeros(0, dtype=_CONTEXT)
    gram = chosen[at]
    new = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (text_of[1:] != text_of[:-1])]))
    last = np.append(new[1:], len(at)) - 1
    start, end, anchor = at[new], at[last] + length, gram[new]
    out = np.empty(len(new), dtype=_CONTEXT)
    out["gram"], out["row"] = grams[anchor], np.asarray(rows, dtype=np.int64)[text_of[new]]
    out["start"], out["more"], out["lead"] = start - (ends - sizes)[text_of[new]], last - new, anchor - start
    with np.errstate(over="ignore"):
        out["hash"] = mix(ranges.of(start, end) + out["lead"].astype(U) * odd(3))
    return out


_BLOCK = pa.schema([("part", pa.int32()), ("block", pa.binary())])
_SPAN = pa.schema([("row", pa.int64()), ("start", pa.int64()), ("more", pa.int64()), ("gram", pa.int64()), ("lead", pa.int64()), ("kind", pa.int32())])
_SPAN_SQL = "row long, start long, more long, gram long, lead long, kind int"
COVERED, ASKED, SHOWN = 0, 1, 2


def _in_batches(batches: Iterator[pa.RecordBatch], *names: str):
    held, size = [], 0
    for batch in batches:
        for values in zip(*(batch.column(x) for x in names), strict=True):
            values = tuple(v.as_py() for v in values)
            held.append(values)
            size += len(values[0])
            if size > BATCH:
                yield held
                held, size = [], 0
    if held:
        yield held


def _hashed(parts: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, count = [], 0

        def flush():
            found = np.concatenate(waiting)
            to = (found["gram"] % U(parts)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            found, at = found[order], np.concatenate([[0], np.cumsum(np.bincount(to, minlength=parts))])
            full = np.flatnonzero(np.diff(at))
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([found[at[p] : at[p + 1]].tobytes() for p in full], pa.binary())], schema=_BLOCK)

        for held in _in_batches(batches, "text", "row"):
            waiting.append(contexts([t for t, _ in held], [r for _, r in held], length))
            count += len(waiting[-1])
            if count > 1 << 18:
                yield from slices(flush())
                waiting, count = [], 0
        if count:
            yield from slices(flush())

    return run


def classified(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(contexts, kinds): covered ones, ones whose bytes are asked for, and ones covered already that are shown to these."""
    found = found[np.lexsort((found["start"], found["row"], found["hash"], found["gram"]))]
    if not len(found):
        return found, np.zeros(0, dtype=np.int32)
    new_gram = np.concatenate([[True], found["gram"][1:] != found["gram"][:-1]])
    new_class = new_gram | np.concatenate([[True], found["hash"][1:] != found["hash"][:-1]])
    first, of_class = np.flatnonzero(new_class), np.cumsum(new_class) - 1
    size = np.bincount(of_class)
    gram = np.cumsum(new_gram) - 1
    classes = np.bincount(gram[first])
    again = np.concatenate([[False], (found["row"][1:] == found["row"][:-1]) & (found["start"][1:] == found["start"][:-1])]) & ~new_class
    covered = (size[of_class] > 1) & ~again  # repeated rows have one key and need one answer
    mixed = new_class & (classes[gram] > 1)
    pick = np.concatenate([np.flatnonzero(covered), np.flatnonzero(mixed)])
    kinds = np.concatenate([np.full(covered.sum(), COVERED), np.where(size[of_class[mixed]] > 1, SHOWN, ASKED)])
    return found[pick], kinds.astype(np.int32)


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The blocks of each shard of a partition, which is sorted by part."""
    now, held = None, []
    for batch in batches:
        for part, block in zip(batch.column("part").to_pylist(), batch.column("block"), strict=True):
            if part != now and held:
                yield held
                held = []
            now = part
            held.append(block.as_py())
    if held:
        yield held


def _classified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for blocks in _by_part(batches):
        found, kinds = classified(np.frombuffer(b"".join(blocks), dtype=_CONTEXT))
        for lo in range(0, len(found), 20_000):
            x = found[lo : lo + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(x[c].astype(np.int64)) for c in ("row", "start", "more")] + [pa.array(np.ascontiguousarray(x["gram"]).view(np.int64)), pa.array(x["lead"].astype(np.int64)), pa.array(kinds[lo : lo + 20_000])], schema=_SPAN)


_ASK = np.dtype([("gram", "<u8"), ("row", "<i8"), ("start", "<u4"), ("more", "<u2"), ("kind", "<u2")])


def _bytes_of(parts: int, length: int):
    """Texts with the contexts asked of them, to the packed bytes of these for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, list[bytes]] = {}
        held = 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([b"".join(x) for x in out.values()], pa.binary())], schema=_BLOCK)

        for batch in batches:
            for text, row, asks in zip(*(batch.column(x) for x in ("text", "row", "asks")), strict=True):
                text, row = text.as_py(), row.as_py()
                for ask in asks.as_py():
                    head = np.array([(ask["gram"] % (1 << 64), row, ask["start"], ask["more"], ask["kind"])], dtype=_ASK).tobytes()
                    piece = text[ask["start"] : ask["start"] + ask["more"] + length]
                    out.setdefault(ask["gram"] % (1 << 64) % parts, []).append(head + piece)
                    held += len(piece)
                if held > 8 << 20:
                    yield from slices(flush())
                    out, held = {}, 0
        if held:
            yield from slices(flush())

    return run


def repeated_strings(pieces: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Of each piece the starts of its strings of this length that start anywhere else in the pieces too."""
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    text = np.frombuffer(b"".join(x for p in pieces for x in (p, b"\0")) + b"\0", dtype=np.uint8).astype(np.int64) + 2
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    text[starts[1:] - 1], text[-1] = 1, 0  # ends of pieces; the end of all
    order = suffix_array(text)
    # No string crosses the end of its piece: values compared anew at each start are large enough for all of a piece.
    shared = common_prefixes(text, order, max(length, int(sizes.max(initial=0))), starts[:-1])
    twice = shared >= length
    twice[order[:-1]] |= shared[order[1:]] >= length
    return [np.flatnonzero(twice[s : s + max(0, n - length + 1)]) for s, n in zip(starts, sizes, strict=False)]


def _sorted(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks in _by_part(batches):
            yield from shard(blocks)

    def shard(blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
        asks: dict[int, list] = {}
        for raw in blocks:
            at = 0
            while at < len(raw):
                gram, row, start, more, kind = np.frombuffer(raw, dtype=_ASK, count=1, offset=at)[0].tolist()
                at += _ASK.itemsize
                asks.setdefault(gram, []).append((row, start, kind, raw[at : at + more + length]))
                at += more + length
        held, size = [], 0

        def spans():
            out = []
            for (row, start, kind, _), found in zip(held, repeated_strings([x[3] for x in held], length), strict=True):
                if kind == ASKED and len(found):
                    cut = np.flatnonzero(np.diff(found) > 1)
                    for lo, hi in zip(found[np.append(0, cut + 1)], found[np.append(cut, len(found) - 1)], strict=True):
                        out.append((row, start + int(lo), int(hi - lo)))
            none = pa.nulls(len(out), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)] + [none, none, pa.array([COVERED] * len(out), pa.int32())], schema=_SPAN)

        for same in asks.values():  # strings of different grams never match: sort a bounded number of grams at a time
            seen = set()
            for ask in same:
                if ask[:2] not in seen:  # repeated rows would answer twice
                    seen.add(ask[:2])
                    held.append(ask)
                    size += len(ask[3])
            if size > SORTED:
                yield spans()
                held, size = [], 0
        if held:
            yield spans()

    return run


def _keyed(docs: DataFrame, *more) -> DataFrame:
    return docs.select(*more, F.coalesce("text", F.lit("")).cast("binary").alias("text"), row_key("doc_id", "text").alias("row"))


def covered_spans(keyed: DataFrame, length: int = LENGTH) -> DataFrame:
    """(row, spans): of each row of keyed (text: bytes, row: a key) that has any, the strings covered, as an array of (start, more)."""
    parts = partitions(keyed.sparkSession, keyed)
    shards = lambda df: df.repartition(parts, "part").sortWithinPartitions("part")
    sent = shards(keyed.where(F.length("text") >= length).select("text", "row").mapInArrow(_hashed(4 * parts, length), "part int, block binary"))
    found = stored(sent.mapInArrow(_classified, _SPAN_SQL), "suffix-contexts")
    asks = found.where(F.col("kind") != COVERED).groupBy("row").agg(F.collect_list(F.struct("gram", "start", "more", "kind")).alias("asks"))
    asks = stored(asks.withColumnRenamed("row", "r"), "suffix-asks")
    wanted = keyed.join(asks.hint("merge"), F.col("row") == F.col("r")).select("text", "row", "asks")
    answers = shards(wanted.mapInArrow(_bytes_of(4 * parts, length), "part int, block binary")).mapInArrow(_sorted(length), _SPAN_SQL)
    spans = found.where(F.col("kind") == COVERED).unionByName(answers).groupBy("row").agg(F.collect_list(F.struct("start", "more")).alias("spans"))
    spans = stored(spans, "suffix-spans")
    drop_stored(found, asks)
    return spans


def _runs(starts, mores, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs that some strings cover."""
    if not len(starts):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    order = np.argsort(starts, kind="stable")
    lo, hi = np.asarray(starts)[order], np.maximum.accumulate((np.asarray(starts) + np.asarray(mores) + length)[order])
    new = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
    return lo[new], hi[np.append(new[1:], len(hi)) - 1]


def _cut(raw: bytes, starts, mores, length: int) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal runs removed)"""
    begins, ends = _runs(starts, mores, length)
    if not len(begins):
        return raw, 0, 0
    kept = b"".join(raw[a:b] for a, b in zip([0, *ends], [*begins, len(raw)], strict=True))
    return kept, len(raw) - len(kept), len(begins)


def _with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    return rows.join(spans.withColumnRenamed("row", "r").hint("merge"), F.col("row") == F.col("r"), "left").withColumn("starts", F.coalesce(F.col("spans.start"), F.array().cast("array<bigint>"))).withColumn("mores", F.coalesce(F.col("spans.more"), F.array().cast("array<bigint>")))


_PIECE = pa.schema([("row", pa.int64()), ("of", pa.int64()), ("at", pa.int64()), ("covered", pa.int64()), ("text", pa.binary())])
_PIECE_SQL = "row long, of long, at long, covered long, text binary"


def _pieces(passage: int, length: int):
    """Of each text with spans a row without text for the bytes they cover, and one for each run of `length` bytes or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, row, starts, mores in zip(*(batch.column(x) for x in ("text", "row", "starts", "mores")), strict=True):
                text, row = text.as_py(), row.as_py()
                lo, hi = _runs(starts.values.to_numpy(), mores.values.to_numpy(), passage)
                out.append((None, row, None, int((hi - lo).sum()), None))
                for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
                    if b - a >= length:
                        out.append((xxhash.xxh3_64_intdigest(f"{row} {a}") - (1 << 63), row, a, None, text[a:b]))
            yield from slices(pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], f.type) for k, f in enumerate(_PIECE)], schema=_PIECE))

    return run


def _both_lengths(keyed: DataFrame, length: int, passage: int) -> DataFrame:
    """(row, spans, covered): strings of `length` bytes that repeat, and the bytes that strings of `passage` bytes cover, for each row that has any of the latter."""
    spans = covered_spans(keyed, passage)
    wide = _with_spans(keyed.select("text", "row"), spans).where(F.size("starts") > 0).select("text", "row", "starts", "mores")
    pieces = stored(wide.mapInArrow(_pieces(passage, length), _PIECE_SQL), "suffix-pieces")
    inner = covered_spans(pieces.where("row is not null").select("text", "row"), length).withColumnRenamed("row", "p")
    of = pieces.where("row is not null").select(F.col("row").alias("q"), "of", "at").distinct()
    moved = inner.join(of, F.col("p") == F.col("q")).select(F.col("of").alias("row"), F.transform("spans", lambda x: F.struct((x["start"] + F.col("at")).alias("start"), x["more"].alias("more"))).alias("spans"))
    moved = moved.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    covered = pieces.where("row is null").groupBy(F.col("of").alias("o")).agg(F.max("covered").alias("covered"))
    return stored(covered.join(moved, F.col("o") == F.col("row"), "left").select(F.col("o").alias("row"), "spans", "covered"), "suffix-both")


def removed_repeats(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_kept, n_repeated of each row of docs (doc_id, text); n_repeated: bytes that repeated strings of `passage` bytes, at most `length`, cover."""

    @F.pandas_udf("n_removed bigint, n_spans bigint, kept_sha256 string")
    def judged(texts: pd.Series, starts: pd.Series, mores: pd.Series) -> pd.DataFrame:
        out = [_cut(t, s, m, length) for t, s, m in zip(texts, starts, mores, strict=True)]
        return pd.DataFrame([(n, k, hashlib.sha256(t).hexdigest()) for t, n, k in out], columns=["n_removed", "n_spans", "kept_sha256"])

    rows = _with_spans(_keyed(docs, "doc_id"), _both_lengths(_keyed(docs), length, min(passage, length)))
    n_bytes = F.length("text").cast("long")
    out = rows.select("doc_id", n_bytes.alias("n_bytes"), judged("text", "starts", "mores").alias("x"), F.coalesce("covered", F.lit(0)).cast("long").alias("n_repeated"))
    return out.select("doc_id", "n_bytes", "x.*", (F.col("n_bytes") - F.col("x.n_removed")).alias("n_kept"), "n_repeated")


def drop_repeats(docs: DataFrame, length: int = PASSAGE) -> DataFrame:
    """docs with the repeated strings cut out of the texts, and n_chars, where there is one, counted anew; characters that lose some of their bytes go."""

    @F.pandas_udf("string")
    def left(texts: pd.Series, starts: pd.Series, mores: pd.Series) -> pd.Series:
        return pd.Series([_cut(t, s, m, length)[0].decode("utf-8", "ignore") for t, s, m in zip(texts, starts, mores, strict=True)])

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("all")
    rows = _with_spans(_keyed(docs, row), covered_spans(_keyed(docs), length))
    text = F.when(F.size("starts") == 0, F.col("all.text")).otherwise(left("text", "starts", "mores"))
    rows = rows.select("all", text.alias("cut"))
    new = {"text": F.col("cut"), "n_chars": F.coalesce(F.char_length("cut").cast("long"), F.col("all.n_chars")) if "n_chars" in docs.columns else None}
    return rows.select(*[(new.get(c) if new.get(c) is not None else F.col(f"all.`{c}`")).alias(c) for c in docs.columns])
