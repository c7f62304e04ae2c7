"""Mail as a stream: new raw messages are deduplicated by key and appended to a message table.

Arrival replaces file order: the first copy to arrive wins. The label filter runs before the parser, so a
skipped copy never hides a wanted one. The stream itself has no state: each micro-batch is compared with
the keys of the table, a column of its own, in foreachBatch, and adds one part with the rows that are new.
A pointer file names the parts and the last batch; it is replaced at once, so a batch that is retried
changes nothing. Parts of one level are merged into one of the next when there are `FAN` of them, so a row
is rewritten a few times at most; the parts that a merge leaves behind go one commit later, when no reader
that began before it should need them.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from maillake.functions.mime import parse_messages
from maillake.operators import mail as M
from maillake.options import ConvertOptions
from maillake.plans.convert import with_headers

FAN = 16


def wanted(messages: DataFrame, options: ConvertOptions = ConvertOptions()) -> DataFrame:
    """A streaming or static (file, ordinal, raw) without skipped labels."""
    return M.without_labels(with_headers(messages), options.skip_labels)


def _pointer(path: str) -> dict:
    """batch: the last one; parts: [name, level] of each; left: parts that the last commit left behind."""
    at = Path(path) / "CURRENT"
    return json.loads(at.read_text()) if at.exists() else {"batch": -1, "parts": [], "left": []}


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The table's committed rows, if there are any parts."""
    parts = _pointer(path)["parts"]
    return spark.read.parquet(*[f"{path}/{name}" for name, _ in parts]) if parts else None


def spread(messages: DataFrame) -> DataFrame:
    """The messages of a batch over all cores: all rows of a file may be in one of its splits, and parsing is most of the work."""
    return messages.repartition(2 * messages.sparkSession.sparkContext.defaultParallelism)


def merge(batch: DataFrame, batch_id: int, path: str, options: ConvertOptions) -> None:
    """Add the messages whose key the table doesn't have; a batch seen before changes nothing."""
    spark, now = batch.sparkSession, _pointer(path)
    if batch_id <= now["batch"]:
        return
    rows = parse_messages(spread(batch), options, keep_data=False).where("status = 'ok'").select("msg.*")
    new, old = M.first_wins(rows, "key", "date_utc"), current(spark, path)
    if old is not None:
        new = M.not_known(new, old.select("key"))

    def part(df: DataFrame) -> str:
        name = f"part-{batch_id:08d}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{path}/{name}")
        return name

    parts, left = [*now["parts"], [part(new), 0]], []
    level = 0
    while len(same := [p for p in parts if p[1] == level]) >= FAN:
        whole = spark.read.parquet(*[f"{path}/{name}" for name, _ in same])
        parts = [p for p in parts if p[1] != level] + [[part(whole), level + 1]]
        left += [name for name, _ in same]
        level += 1
    temporary = Path(path) / f".CURRENT.{uuid.uuid4().hex}"
    temporary.write_text(json.dumps({"batch": batch_id, "parts": parts, "left": left}))
    os.replace(temporary, Path(path) / "CURRENT")
    for name in now["left"]:
        shutil.rmtree(Path(path) / name, ignore_errors=True)


def ingest(messages: DataFrame, path: str, checkpoint: str, options: ConvertOptions = ConvertOptions()):
    """Start the stream; it takes what is there and stops. Returns the query."""
    Path(path).mkdir(parents=True, exist_ok=True)
    fresh = wanted(messages, options).select("file", "ordinal", "raw")
    return (
        fresh.writeStream.foreachBatch(lambda df, i: merge(df, i, path, options))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def raw_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(file, ordinal, raw) of files that hold one message each, such as a Maildir's or *.eml, as they arrive."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)
    return files.select(F.col("path").alias("file"), F.lit(1).cast("long").alias("ordinal"), F.col("content").alias("raw"))
