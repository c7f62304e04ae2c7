"""What earlier runs left in an output folder, as DataFrames with fixed schemas."""

from __future__ import annotations

import json
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from maillake.schemas import INDEX_FILE, LEDGER_FILE, MANIFEST, MANIFEST_FILE, PARTS_FOLDER


def _whole_lines(path: Path) -> int:
    """Bytes up to the last line end; a torn last line is no row."""
    with path.open("rb") as f:
        at = f.seek(0, 2)
        while at:
            step = min(at, 1 << 16)
            f.seek(at - step)
            found = f.read(step).rfind(b"\n")
            if found >= 0:
                return at - step + found + 1
            at -= step
    return 0


def read_manifest(spark: SparkSession, outdir: str | Path) -> DataFrame:
    """Rows of the manifest with their line_no; broken rows are left out and missing fields have defaults.

    After them come the rows that tasks of an unfinished run have left.
    """
    path, parts = Path(outdir) / MANIFEST_FILE, Path(outdir) / PARTS_FOLDER
    lines = None
    if path.exists():
        lines = spark.read.text(str(path)).withColumn("line_no", F.monotonically_increasing_id())
        if _whole_lines(path) < path.stat().st_size:
            lines = lines.where(F.col("line_no") < lines.agg(F.max("line_no")).first()[0])
    if any(parts.glob("*.jsonl")):
        # the folder's name begins with a dot, which Spark's sources pass over unless it is named itself
        more = spark.read.text(str(parts)).withColumn("line_no", F.monotonically_increasing_id() + (1 << 58))
        lines = more if lines is None else lines.union(more)
    if lines is None:
        return spark.createDataFrame([], MANIFEST + ", line_no bigint")
    rows = lines.select(F.from_json("value", MANIFEST + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("m"), "line_no")
    none = F.array().cast("array<string>")
    return rows.where("m is not null and m._bad is null and m.path is not null").select("m.*", "line_no").drop("_bad").withColumns(
        {
            **{c: F.coalesce(c, F.lit("")) for c in ("key", "message_id", "subject", "from")},
            "labels": F.coalesce("labels", none),
            "body": F.coalesce("body", F.lit("none")),
            "attachments": F.coalesce("attachments", F.from_json(F.lit("[]"), "array<struct<hash:string,path:string,name:string,size:bigint,type:string>>")),
        }
    )


def read_ledger(spark: SparkSession, outdir: str | Path) -> DataFrame:
    path = Path(outdir) / LEDGER_FILE
    if not path.exists():
        return spark.createDataFrame([], "path string")

    def run(_):  # Spark's own sources pass over names that begin with a dot
        with path.open(encoding="utf-8") as f:
            while lines := f.readlines(1 << 20):
                yield pa.RecordBatch.from_arrays([pa.array([x.rstrip("\n") for x in lines], pa.string())], ["path"])

    return spark.range(1, numPartitions=1).mapInArrow(run, "path string").where("path <> ''").distinct()


def previous_outputs(spark: SparkSession, outdir: str | Path, manifest: DataFrame) -> DataFrame:
    """Distinct paths that earlier runs recorded: ledger, manifest, its attachments, index, failed mails."""
    outdir = Path(outdir)
    parts = [read_ledger(spark, outdir), manifest.select("path"), manifest.select(F.explode("attachments.path").alias("path"))]
    if (outdir / INDEX_FILE).exists():
        rows = spark.read.text(str(outdir / INDEX_FILE)).select(F.get_json_object("value", "$.path").alias("path"))
        parts.append(rows.where("path is not null"))
    failed = [(f"_unparsed/{p.name}",) for p in (outdir / "_unparsed").glob("*.eml")]
    parts.append(spark.createDataFrame(failed, "path string"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def dumps(v) -> str:
    return json.dumps(v, ensure_ascii=False)
