"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..storage import drop_stored, partitions, shared_dir, small_or_not, stored

__all__ = ["WORD", "drop_stored", "partitions", "row_key", "shared_dir", "slices", "small_or_not", "stored"]

#: A word: what lies between the six white-space characters of ASCII.
WORD = r"[^\x20\x09-\x0D]+"


def row_key(*names: str) -> Column:
    """A 64-bit key of a row's content: rows that share it are treated as repeated rows, with equal results."""
    return F.xxhash64(*[F.col(f"`{n}`") for n in names])


def slices(batch: pa.RecordBatch, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about so many bytes, as the JVM holds a whole batch outside its heap."""
    step = max(1, len(batch) * size // max(1, batch.nbytes))
    for lo in range(0, len(batch), step):
        yield batch.slice(lo, step)
