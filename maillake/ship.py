"""Sends this package to Python workers that don't have it on their path, and bounds what they hold."""

from __future__ import annotations

import io
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of an Arrow batch between the JVM and Python, for sessions that set no bound themselves: what both sides hold a task.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
#: Bytes of a batch that one Python call takes, rows permitting.
SLICE = 1 << 20


def slices(batch: pa.RecordBatch, most: int = 512) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about SLICE bytes, so that a part's Python objects are bounded by bytes; one row at least."""
    rows = max(1, min(most, batch.num_rows * SLICE // max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def ship(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes and, once per context, have the driver's file server hand the archive to every executor."""
    if not spark._jsparkSession.sessionState().conf().contains(BATCH[0]):
        spark.conf.set(*BATCH)
    sc = spark.sparkContext
    if getattr(sc, "_maillake_shipped", False):
        return
    root = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="maillake-ship-")) / "maillake.zip"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    out.write_bytes(buffer.getvalue())
    sc.addPyFile(str(out))
    sc._maillake_shipped = True
