"""Exact token counts of whole texts, huge ones by overlap resynchronisation.

A text above CHUNK characters is encoded in overlapping chunks with offsets. A pre-token boundary that two neighbouring chunks share inside their overlap,
MARGIN characters before the end of the first, is a boundary of the whole text too: the first chunk was cut from a true boundary, its scan up to there doesn't look past its end, and from
one position on both scans read the same characters. The count is spliced there. If an overlap has no common boundary, as in one endless word, it is widened
until it has, up to the rest of the text. So memory is bounded by a few chunks unless a single word is longer.

Defined results: a null text counts as the empty one (0 tokens); special strings inside a text count as the library counts them; repeated
rows get equal results; an empty table gives an empty table; other columns do not matter.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codec import default_path, encoder, library

CHUNK, OVERLAP, MARGIN = 1 << 14, 1 << 9, 64


def _boundaries(encoding, at: int, low: int) -> dict[int, int]:
    """Start of each pre-token after low, in the whole text's characters -> tokens of the chunk before it.

    Tokens of one pre-token share a word number; a special token has none and is a pre-token of its own.
    """
    words, offsets = encoding.word_ids, encoding.offsets
    n = max(0, bisect_right(offsets, (low - at, 0)) - 1)
    while n and offsets[n][0] >= low - at:  # the token that holds low, or the one before it
        n -= 1
    found, last, seen_end = {}, words[n] if n < len(words) else None, offsets[n][1] if n < len(offsets) else 0
    for k in range(n + 1, len(words)):
        word, (start, end) = words[k], offsets[k]
        if word is None or word != last or start > seen_end:
            found.setdefault(at + start, k)
        last, seen_end = word, max(seen_end, end)
    return found


def count_tokens(text: str, path: str, chunk: int = CHUNK, overlap: int = OVERLAP, margin: int = MARGIN) -> int:
    if len(text) <= chunk:
        return len(encoder(path)(text))
    lib = library(path)
    margin = max([margin, *(4 + len(t.content) for t in lib.get_added_tokens_decoder().values())])

    def encoded(lo: int, hi: int):
        return lib.encode(text[lo:hi], add_special_tokens=False)

    total, start, size = 0, 0, chunk  # start: a true boundary of the whole text
    while True:
        end = min(len(text), start + size)
        first = encoded(start, end)
        if end == len(text):
            return total + len(first.ids)
        step = max(overlap, 2 * margin)
        splice = None
        while splice is None and step < end - start:
            mine, other = _boundaries(first, start, end - step), _boundaries(encoded(end - step, min(len(text), end + step)), end - step, end - step)
            # The first common boundary after the second chunk's own start.
            splice = min((p for p in mine if end - step < p <= end - margin and p in other), default=None)
            step *= 2
        if splice is None:
            size *= 2
            continue
        total, start, size = total + mine[splice], splice, chunk


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of docs (doc_id, text)."""
    path = path or default_path()

    @F.pandas_udf("long")
    def counted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([count_tokens(t, path) for t in texts], dtype="int64")

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), counted(text).alias("n_tokens"))
    return rows.select("*", (F.col("n_tokens") > limit).alias("over_limit"))
