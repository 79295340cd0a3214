"""Hands this package to the executors, which may not have it on their path, and keeps Arrow batches small."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Bytes that a batch to a Python worker may have.
BATCH_BYTES = 4 << 20
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Add the package's sources to the job once for each application; the driver serves them to every executor."""
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(batch) == "10000":  # the default: batches of long texts would take much memory on both sides
        spark.conf.set(batch, "2000")
    whole = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(whole, "2147483647")) > BATCH_BYTES:  # the default is all that an Arrow batch can hold
        spark.conf.set(whole, str(BATCH_BYTES))
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        top = Path(__file__).resolve().parent
        if top.is_dir():
            target = Path(tempfile.mkdtemp(prefix="tessella-src-")) / "tessella_src.zip"
            with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
                for f in sorted(top.rglob("*.py")):
                    z.write(f, f.relative_to(top.parent))
            context.addPyFile(str(target))
    return spark
