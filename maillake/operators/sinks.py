"""File sinks. Tasks write under a temporary name and rename, so a rerun task leaves the same tree."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from maillake.ship import slices


#: Files between two records of a log.
LOGGED = 256
#: Bytes of a piece that are copied at once.
STEP = 1 << 20


def put(path: Path, data: bytes) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.parent / f".{path.name}.{uuid.uuid4().hex}.tmp"
    try:
        part.write_bytes(data)
        os.replace(part, path)
    finally:
        part.unlink(missing_ok=True)


def put_lines(path: Path, lines: Iterable[str]) -> None:
    """Replace a text file at once; lines are streamed."""
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.parent / f".{path.name}.{uuid.uuid4().hex}.tmp"
    try:
        with open(part, "w", newline="\n", encoding="utf-8") as f:
            f.writelines(f"{x}\n" for x in lines)
        os.replace(part, path)
    finally:
        part.unlink(missing_ok=True)


def write_whole(rows: DataFrame, outdir: str | Path, order: list[str], render: Callable[[dict], bytes], name: str | None = None) -> list[Path]:
    """Write rows below outdir, one after another in order: a file for each value of the column `_file`, or the one called name.

    Tasks write a range of the rows each, which then is copied to its place in the file by tasks too: neither the driver nor
    one task sees all of a file. Files are replaced at once; the one called name is written even without rows.
    """
    from pyspark import TaskContext
    from pyspark.sql import functions as F

    out, spark = Path(outdir), rows.sparkSession
    folder = out / f".pieces-{uuid.uuid4().hex}"
    folder.mkdir(parents=True)
    root = str(folder)
    if name is not None:
        rows = rows.withColumn("_file", F.lit(name))
    by = ["_file", *order] if name is None else order
    columns = [c for c in rows.columns if c != "_file"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, now, f = TaskContext.get().partitionId(), None, None
        done: list[dict] = []
        try:
            for batch in batches:
                for r in slices(batch):
                    for x in r.to_pylist():
                        if x["_file"] != now or f is None:
                            if f is not None:
                                f.close()
                            now, piece = x["_file"], f"{root}/{task}-{uuid.uuid4().hex}"
                            f = open(piece, "wb")
                            done.append({"name": now, "task": task, "piece": piece})
                        f.write(render({c: x[c] for c in columns}))
        finally:
            if f is not None:
                f.close()
        for d in done:
            d["size"] = os.path.getsize(d["piece"])
        yield pa.RecordBatch.from_pylist(done, pa.schema({"name": pa.string(), "task": pa.int64(), "piece": pa.string(), "size": pa.int64()}))

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with open(r["piece"], "rb") as f, open(r["part"], "r+b") as to:
                    to.seek(r["at"])
                    shutil.copyfileobj(f, to, STEP)
            yield batch.select(["at"])

    try:
        # a row a task and file, so few
        pieces = rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(write, "name string, task long, piece string, size long").collect()
        whole, moves = {name: str(folder / "none")} if name is not None else {}, []
        if name is not None:
            Path(whole[name]).touch()
        for k, (target, group) in enumerate(groupby(sorted(pieces, key=lambda r: (r.name, r.task)), key=lambda r: r.name)):
            group = list(group)
            if len(group) == 1:
                whole[target] = group[0].piece
                continue
            whole[target], at = str(folder / f"whole-{k}"), 0
            with open(whole[target], "wb") as f:
                f.truncate(sum(r["size"] for r in group))
            for r in group:
                moves.append((r.piece, whole[target], at))
                at += r["size"]
        if moves:
            plan = spark.createDataFrame(moves, "piece string, part string, at long").coalesce(1).repartition(min(len(moves), max(2, spark.sparkContext.defaultParallelism)))
            plan.mapInArrow(copy, "at long").count()
        for target, part in whole.items():
            (out / target).parent.mkdir(parents=True, exist_ok=True)
            os.replace(part, out / target)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    return sorted(out / target for target in whole)


def line(row: dict) -> bytes:
    """A row as a line of JSON, for write_whole."""
    return (json.dumps(row, ensure_ascii=False) + "\n").encode()


def text(row: dict) -> bytes:
    """The one column of a row as a line, for write_whole."""
    return ("".join(row.values()) + "\n").encode()


def write_files(files: DataFrame, outdir: str | Path, keep: bool = False, log: str | Path | None = None) -> int:
    """Write files (path, data) below outdir, spread over tasks; `keep` leaves existing files as they are.

    With `log`, a folder, the column `line` of each few files is written there once they are, so that a run that is killed
    leaves a record of what it wrote.
    """
    root = str(outdir)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, LOGGED):
                part = batch.slice(at, LOGGED)
                for path, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    target = Path(root) / path
                    if not (keep and target.exists()):
                        put(target, data if isinstance(data, bytes) else data.encode("utf-8", "replace"))
                if log is not None:
                    put(Path(log) / f"{uuid.uuid4().hex}.jsonl", "".join(f"{x}\n" for x in part.column(2).to_pylist()).encode())
                yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int64())], ["n"])

    names = ["path", "data"] if log is None else ["path", "data", "line"]
    return sum(r.n for r in files.select(names).mapInArrow(run, "n bigint").groupBy().sum("n").withColumnRenamed("sum(n)", "n").collect() if r.n)


def prune(outdir: str | Path, stale: Iterable[str]) -> int:
    """Delete files below outdir and the folders that this empties. Paths that lead elsewhere are left alone."""
    root, gone = Path(outdir).resolve(), 0
    for rel in sorted(stale):
        target = (root / rel).resolve()
        if target == root or root not in target.parents or not target.is_file():
            continue
        target.unlink()
        gone += 1
        for folder in target.parents:
            if folder == root or any(folder.iterdir()):
                break
            folder.rmdir()
    return gone


def write_tables(messages: DataFrame, path: str) -> None:
    """Parsed messages (msg.*) as Parquet by year and month, for querying; messages without a date have neither."""
    from pyspark.sql import functions as F

    day = F.to_date(F.substring("date_iso", 1, 10))
    messages.withColumns({"year": F.year(day), "month": F.month(day)}).write.mode("overwrite").partitionBy("year", "month").parquet(path)
