"""A whole conversion: mailbox to Markdown tree, attachment store, manifest, index, ledger and statistics.

Headers are read with native columns in a first pass, and label, known-key and duplicate filters run on
narrow rows. What they drop goes to the reading tasks as a list a range, so raw mail is never shuffled and
a dropped message never leaves its reader. The parsed rows are persisted, as four branches read them.
Paths are made canonical and labels merged before anything is written, so no file is written twice.
Attachments are written first, then messages, each few with their manifest rows beside them: a run that is
killed leaves those rows, and an incremental run goes on from there.
"""

from __future__ import annotations

import shutil
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from maillake.functions import headers as H
from maillake.functions.mime import decode_labels, parse_messages
from maillake.operators import mail as M
from maillake.operators import sinks
from maillake.operators.render import document
from maillake.options import ConvertOptions, WorkerError
from maillake.schemas import ERRORS_FILE, INDEX_FILE, LEDGER_FILE, MANIFEST_FILE, PARTS_FOLDER
from maillake.ship import ship
from maillake.sources.manifest import dumps, previous_outputs, read_manifest
from maillake.sources.mbox import SPLIT, bytes_read, check, read_mbox


ERROR_FIELDS = "key message_id error path".split()
#: Narrow rows (renamed attachments, failed messages, shared paths) that are broadcast at most; more are joined.
RENAMED = 100_000
#: Bytes of a range at least.
LEAST_SPLIT = 4 << 20


@dataclass
class ConvertStats:
    """Counts of a run; `processed` leaves out further copies."""

    ok: int = 0
    errors: int = 0
    skipped: int = 0
    out_of_range: int = 0
    already_converted: int = 0
    duplicate_message_ids_skipped: int = 0
    labels_updated: int = 0
    path_collisions: int = 0
    body_html: int = 0
    body_plain: int = 0
    body_none: int = 0
    markdown_bytes: int = 0
    unique_attachments: int = 0
    attachment_refs: int = 0
    attachment_bytes_stored: int = 0
    attachment_bytes_referenced: int = 0
    pruned: int = 0
    stale_files: int = 0
    bytes_total: int = 0
    bytes_read: int = 0
    dry_run: bool = False
    elapsed_s: float = 0.0

    @property
    def processed(self) -> int:
        return sum((self.already_converted, self.errors, self.ok, self.out_of_range, self.skipped))

    def as_dict(self) -> dict:
        return asdict(self)


#: Hears of a failed message's path (None in a dry run) and error; of the counts so far.
OnError, OnProgress = Callable[[str | None, str], None], Callable[[ConvertStats], None]


def with_headers(messages: DataFrame) -> DataFrame:
    """Add key and labels, read from the header block alone."""
    head = H.header_block(H.latin(F.col("raw")))

    @F.pandas_udf("array<string>")
    def coded(values):
        return values.map(lambda v: None if v is None else decode_labels(v))

    rows = messages.withColumns({"key": H.message_key(head), "_labels": H.labels_value(head)})
    odd = H.encoded(F.col("_labels"))
    only = F.when(odd, F.col("_labels"))  # all others pass null to the parser
    return rows.withColumn("labels", F.when(odd, coded(only)).otherwise(H.labels(F.col("_labels")))).drop("_labels")


def _references(rows: DataFrame) -> DataFrame:
    """(hash, path, name, size, message_path, seq) of rows (path, ordinal, attachments)."""
    return rows.select(F.col("path").alias("message_path"), "ordinal", F.posexplode("attachments").alias("pos", "a")).select(
        "a.hash", "a.path", "a.name", "a.size", "message_path", F.struct("ordinal", "pos").alias("seq")
    )


def convert(
    spark: SparkSession, src: str | Path, outdir: str | Path | None, options: ConvertOptions = ConvertOptions(), *,
    on_error: OnError | None = None, on_progress: OnProgress | None = None,
) -> ConvertStats:
    """Convert the mailbox at src into outdir. Both must be reachable by every executor.

    on_progress hears of each phase that ends and, while messages are parsed, twice a second of how many are;
    on_error(path, error) of each failed message. A dry run writes nothing. One damaged message is an error
    row, never a failed run. Raises ReadError if the
    mailbox can't be read and WorkerError if the Spark job fails.
    """
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import AnalysisException, PySparkException

    try:
        return _convert(spark, src, outdir, options, on_error, on_progress)
    except AnalysisException:
        raise  # a mistake in the plan, not the workers' fault
    except (Py4JJavaError, PySparkException) as e:
        raise WorkerError(f"the run's Spark job failed: {str(e).splitlines()[0]}") from e


def _convert(
    spark: SparkSession, src: str | Path, outdir: str | Path | None, options: ConvertOptions, on_error: OnError | None, on_progress: OnProgress | None
) -> ConvertStats:
    began = time.time()
    ship(spark)
    size, _ = check(src)
    stats = ConvertStats(bytes_total=size, bytes_read=bytes_read(spark, src, options.limit), dry_run=options.dry_run)
    tell = lambda: (setattr(stats, "elapsed_s", time.time() - began), on_progress(stats) if on_progress else None)
    dry = options.dry_run
    out = Path(outdir) if outdir is not None else Path(".")
    held: list[DataFrame] = []

    def hold(df: DataFrame) -> DataFrame:
        held.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return held[-1]

    none = spark.createDataFrame([], "key string")
    if dry:
        previous, old = none, None
    else:
        out.mkdir(parents=True, exist_ok=True)
        previous = hold(read_manifest(spark, out))
        old = hold(previous_outputs(spark, out, previous))
        old.count(), previous.count()  # read before anything is written
    incremental = options.incremental and not dry
    known = M.last_wins(previous.where("key <> ''"), "key", "line_no") if incremental else None

    # four ranges a core, so that a mailbox of a few SPLITs is parsed by all of them
    split = min(SPLIT, max(LEAST_SPLIT, size // (4 * spark.sparkContext.defaultParallelism)))
    reading = {"unescape_from": options.unescape_from, "limit": options.limit, "split_bytes": split}
    messages = with_headers(read_mbox(spark, src, places=True, **reading))
    narrow = hold(messages.select("file", "start", "ordinal", "key", "labels", H.skips(F.col("labels"), options.skip_labels).alias("skip")))
    wanted = narrow.where("not skip")
    fresh = M.ranked(M.not_known(wanted, known) if known is not None else wanted)
    extra = fresh.where("copy > 1").drop("copy")
    relabelled = M.known_only(wanted, known) if known is not None else wanted.limit(0)
    stats.skipped = narrow.where("skip").count()
    stats.already_converted = relabelled.count()
    stats.duplicate_message_ids_skipped = extra.count()
    tell()

    gone = narrow.where("skip").select("file", "start", "ordinal").union(extra.select("file", "start", "ordinal"))
    gone = gone.union(relabelled.select("file", "start", "ordinal"))
    first = read_mbox(spark, src, drop=gone, **reading)
    seen = spark.sparkContext.accumulator(0)
    parsed = hold(parse_messages(first, options, keep_data=not dry, seen=seen))

    def progress() -> None:
        stats.ok = seen.value  # messages whose task has ended; the exact counts follow
        tell()

    status = {r["status"]: r["count"] for r in _watched(lambda: parsed.groupBy("status").count().collect(), progress if on_progress else None)}
    stats.ok, stats.errors = status.get("ok", 0), status.get("error", 0)
    stats.skipped += status.get("label", 0)
    stats.out_of_range = status.get("date", 0)
    tell()

    good = parsed.where("status = 'ok'").select("ordinal", "msg.*").withColumn(
        "attachments",
        F.expr("transform(attachments, a -> named_struct('hash', a.hash, 'path', concat('attachments/', substr(a.hash, 1, 2), '/', a.hash, a.ext), 'name', a.name, 'size', a.size, 'type', a.content_type))"),
    )
    refs = _references(good)
    if known is not None:
        refs = refs.union(_references(known.withColumn("ordinal", F.col("line_no") - (1 << 60))))
    refs = hold(refs)
    index = hold(M.attachment_index(refs))
    best = index.select(F.col("hash").alias("h"), F.col("path").alias("best"))

    def canonical(rows: DataFrame) -> DataFrame:
        """Attachments with canonical paths, in their order; messages without any aren't joined."""
        a = rows.select("key", F.posexplode("attachments").alias("pos", "a")).join(best, F.col("a.hash") == F.col("h"))
        a = a.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("a").withField("path", F.col("best")).alias("a")))).alias("_a"))
        empty = F.filter("attachments", lambda x: F.lit(False))
        return rows.join(a, "key", "left").withColumn("attachments", F.coalesce(F.transform("_a", lambda x: x["a"]), empty)).drop("_a")

    merged = canonical(good).join(M.label_union(extra), "key", "left")
    merged = merged.withColumns({"_own": F.col("labels"), "labels": M.merged_labels(F.col("labels"), F.col("run_labels"))})
    depth = F.size(F.split("path", "/")) - 1
    fields = {k: F.col(v) for k, v in {"message_id": "message_id", "date": "date_iso", "from": "sender", "to": "to", "cc": "cc", "subject": "subject", "labels": "labels", "thread_id": "thread_id", "body_kind": "body_kind"}.items()}
    plain = fields | {"labels": F.col("_own")}
    written = merged.withColumns({
        "markdown": document(fields, F.col("body"), F.col("attachments"), depth),
        "_size": F.octet_length(document(plain, F.col("body"), F.col("attachments"), depth)),
    })
    written = hold(written)
    kind = F.coalesce("body_kind", F.lit("none"))
    count = lambda c: F.count(F.when(c, 1))
    r = written.agg(
        count(kind == "plain"), count(kind == "html"), count(kind == "none"), F.coalesce(F.sum("_size"), F.lit(0)),
        count(F.col("labels") != F.col("_own")), F.coalesce(F.sum(F.size("attachments")), F.lit(0)), F.count("*") - F.countDistinct("path"),
    ).first()
    stats.body_plain, stats.body_html, stats.body_none, stats.markdown_bytes, relabels, stats.attachment_refs, stats.path_collisions = r
    t = M.stored_bytes(refs).first()
    stats.unique_attachments, stats.attachment_bytes_stored, stats.attachment_bytes_referenced = t.unique_attachments, t.bytes_stored, t.bytes_referenced
    tell()

    failed = parsed.where("status = 'error'").select("ordinal", "key", "message_id", "error", F.concat(F.lit("_unparsed/"), "key", F.lit(".eml")).alias("path"))
    if dry:
        for e in failed.orderBy("ordinal").toLocalIterator():
            if on_error:
                on_error(None, e.error)
        stats.elapsed_s = round(time.time() - began, 1)
        _release(held)
        return stats

    # attachments: every copy may be written, under one name and with the same bytes, so none is moved to meet the others
    data = parsed.where("status = 'ok'").select(F.explode("msg.attachments").alias("a")).select("a.hash", "a.ext", "a.data")
    data = data.withColumn("path", F.concat(F.lit("attachments/"), F.substring("hash", 1, 2), F.lit("/"), "hash", "ext"))
    odd = refs.join(best, F.col("hash") == F.col("h")).where("path <> best").select("h", "best").distinct()
    if (n := odd.count()) <= RENAMED:
        odd = F.broadcast(odd)  # at most RENAMED short rows; beyond, a join by hash
    if n:
        data = data.join(odd, F.col("hash") == F.col("h"), "left").withColumn("path", F.coalesce("best", "path"))
    sinks.write_files(data, out, keep=True)
    # messages; of those that share a path the later one wins, as a later write would
    files = written
    if stats.path_collisions:
        beaten = M.ranked(written.select("path", "ordinal"), "path", "ordinal", last=True).where("copy > 1").select("ordinal")
        files = files.join(F.broadcast(beaten) if stats.path_collisions <= RENAMED else beaten, "ordinal", "left_anti")
    line = F.to_json(F.struct("key", "path", "message_id", F.col("date_iso").alias("date"), "subject", "labels", "thread_id", kind.alias("body"), "attachments", F.col("sender").alias("from")))
    files = files.select("path", F.col("markdown").cast("binary").alias("data"), line.alias("line"))
    sinks.write_files(files, out, log=out / PARTS_FOLDER)
    if stats.errors:
        wrong = failed.select("ordinal", "path")
        raws = read_mbox(spark, src, **reading).join(F.broadcast(wrong) if stats.errors <= RENAMED else wrong, "ordinal")
        raws = raws.select("path", F.col("raw").alias("data"))
        sinks.write_files(raws.dropDuplicates(["path"]), out)
    tell()

    rows = written.select(
        "ordinal", "key", "path", "message_id", F.col("date_iso").alias("date"), "subject", "labels", "thread_id", kind.alias("body"), "attachments", F.col("sender").alias("from")
    )
    if known is not None:
        again = known.join(M.label_union(relabelled), "key", "left").withColumn("_old", F.col("labels"))
        again = again.withColumn("labels", F.coalesce("run_labels", "labels"))
        changed = again.where(F.col("labels") != F.col("_old")).select("path", "labels").collect()  # files to touch, on this disk
        for c in changed:
            _set_labels(out / c.path, c.labels)
        relabels += len(changed)
        rows = canonical(again).withColumn("ordinal", F.col("line_no") - (1 << 60)).select(rows.columns).union(rows)
        _relink(refs, best, out)
    stats.labels_updated = relabels
    rows = hold(rows)
    sinks.write_whole(rows, out, ["ordinal"], lambda r: sinks.line({k: v for k, v in r.items() if k != "ordinal"}), MANIFEST_FILE)
    if (out / "attachments").exists():
        listed = index.select("hash", "path", "size", "names", "messages")
        sinks.write_whole(listed, out, ["hash"], lambda r: sinks.line(r | {"names": dict(r["names"])}), INDEX_FILE)
    errors = failed.orderBy("ordinal").collect() if stats.errors else []
    for e in errors:
        if on_error:
            on_error(e.path, e.error)
    if errors:
        sinks.put_lines(out / ERRORS_FILE, (dumps({c: e[c] for c in ERROR_FIELDS}) for e in errors))
    else:
        (out / ERRORS_FILE).unlink(missing_ok=True)
        if (out / "_unparsed").is_dir() and not any((out / "_unparsed").iterdir()):
            (out / "_unparsed").rmdir()

    current = index.select("path").union(rows.select("path")).union(failed.select("path")).distinct()
    lost = [] if incremental else [r.path for r in M.stale(old, current).toLocalIterator() if (out / r.path).is_file()]
    if options.prune:
        stats.pruned = sinks.prune(out, lost)
        ledger = current
    elif incremental:
        ledger = M.next_ledger(old, current, incremental=True)
    else:
        stats.stale_files = len(lost)
        ledger = spark.createDataFrame([(p,) for p in lost], "path string").union(current).distinct()
    sinks.write_whole(ledger, out, ["path"], sinks.text, LEDGER_FILE)
    shutil.rmtree(out / PARTS_FOLDER, ignore_errors=True)
    _release(held)
    stats.elapsed_s = round(time.time() - began, 1)
    return stats


def _watched(job: Callable, hear: Callable | None, every: float = 0.5):
    """What job() returns; while it runs in a thread of its own, hear() is called in this one."""
    if hear is None:
        return job()
    from pyspark import InheritableThread

    out: dict = {}

    def run() -> None:
        try:
            out["value"] = job()
        except BaseException as e:
            out["error"] = e

    thread = InheritableThread(target=run)
    thread.start()
    while thread.is_alive():
        thread.join(every)
        hear()
    if "error" in out:
        raise out["error"]
    return out["value"]


def _set_labels(path: Path, labels: list[str]) -> None:
    """Replace the labels line of a message file's front matter."""
    if not path.is_file():
        return
    lines = path.read_text(encoding="utf-8").split("\n")
    end = lines.index("---", 1) if "---" in lines[1:] else len(lines)
    for i in range(1, end):
        if lines[i].startswith("labels: "):
            lines[i] = f"labels: {dumps(labels)}"
            break
    sinks.put(path, "\n".join(lines).encode())


def _relink(refs: DataFrame, best: DataFrame, out: Path) -> None:
    """Incremental runs only: messages of earlier runs follow a canonical path that has changed."""
    import re
    from urllib.parse import quote

    moved = refs.where("seq.ordinal < 0").join(best, F.col("hash") == F.col("h")).where("path <> best").select("message_path", "path", "best").distinct().collect()
    for m in moved:
        target = out / m.message_path
        if target.is_file():
            text = target.read_text(encoding="utf-8")
            for a, b in ((m.path, m.best), (quote(m.path), quote(m.best))):
                text = re.sub(re.escape(a) + r"(?![-%.\w])", lambda _, b=b: b, text)
            sinks.put(target, text.encode())
    for old in {m.path for m in moved}:
        new = next(m.best for m in moved if m.path == old)
        if (out / old).is_file():
            if (out / new).exists():
                (out / old).unlink()
            else:
                (out / old).rename(out / new)


def _release(held: list[DataFrame]) -> None:
    for df in held:
        df.unpersist()
