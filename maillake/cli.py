"""Command line: a thin layer over convert() and compress_mbox()."""

from __future__ import annotations

import argparse
import contextlib
import json
import re
import sys
from dataclasses import fields
from datetime import date
from pathlib import Path

from maillake.compress import EXTENSION, compress_mbox
from maillake.options import CompressionError, ConvertOptions, ReadError, WorkerError, cores, zone

_POWER = {"": 0, "b": 0, "k": 10, "m": 20}


def size_of(text: str) -> int:
    """Bytes of 5KB, 5k, 1.5 MB or 0; units are binary."""
    m = re.fullmatch(r"([\d.]+?)\s*(?:(b)|([km])(?:i?b)?)?", text.strip(), re.I)
    try:
        return int(float(m[1]) * (1 << _POWER[(m[3] or "").lower()]))
    except (TypeError, ValueError):
        raise argparse.ArgumentTypeError(f"{text!r} is no size such as 5KB, 1MB or 0") from None


def day_of(text: str) -> date:
    """A day as YYYY-MM-DD."""
    with contextlib.suppress(ValueError):
        return date.fromisoformat(text)
    raise argparse.ArgumentTypeError(f"{text!r} is no day such as 2024-01-31")


def labels_of(text: str) -> frozenset:
    """Labels between commas."""
    return frozenset(filter(None, map(str.strip, text.split(","))))


def readable(n: float) -> str:
    """Bytes in decimal units."""
    if abs(n) < 1000:
        return f"{n:,.0f} B"
    for unit in ("KB", "MB"):
        n /= 1000
        if abs(n) < 1000:
            return f"{n:,.1f} {unit}"
    return f"{n / 1000:,.1f} GB"


#: Options that take a value: how it is read, what it is without, what it does.
VALUES = {
    "since": (day_of, None, "first day wanted"),
    "until": (day_of, None, "last day wanted"),
    "skip-labels": (labels_of, ConvertOptions.skip_labels, "labels to leave out, comma-separated"),
    "limit": (int, None, "read this many messages"),
    "tz": (str, "sender", "zone of file names and day ranges: sender, utc, local or a name"),
    "min-inline-image": (size_of, ConvertOptions.min_inline_image, "leave out smaller inline images"),
    "workers": (int, cores(), "cores of a local Spark master"),
    "compress-level": (int, 5, "1 to 10"),
}
SWITCHES = {
    "strip-quotes": "leave out quoted replies",
    "keep-from-escapes": "leave >From lines as they are",
    "dry-run": "count, write nothing",
    "delete-source": "delete the mailbox once its compressed copy is verified",
}
#: Switches of which one at most may be given.
EITHER = (
    {"incremental": "only messages that aren't in the output yet", "prune": "delete files of earlier runs that this one doesn't make"},
    {"quiet": "say nothing but errors", "verbose": "name each failed message", "json": "statistics as JSON"},
)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("maillake", description="Turn a mailbox into Markdown files and queryable tables, with Spark.")
    p.add_argument("mbox", help="mailbox, plain or compressed with zstd or gzip", type=Path)
    p.add_argument("outdir", help="where the files go; a dry run needs none", nargs="?", type=Path)
    p.add_argument("--version", version="maillake 0.1", action="version")
    p.add_argument("--compress-source", help="compress the mailbox afterwards, verified", choices=sorted(EXTENSION))
    for name, (kind, default, text) in VALUES.items():
        p.add_argument(f"--{name}", help=text, default=default, type=kind)
    for name, text in SWITCHES.items():
        p.add_argument(f"--{name}", help=text, action="store_true")
    for names in EITHER:
        group = p.add_mutually_exclusive_group()
        for name, text in names.items():
            short = [f"-{name[0]}"] if name in ("quiet", "verbose") else []
            group.add_argument(*short, f"--{name}", help=text, action="store_true")
    return p


def _refusals(a) -> str | None:
    rules = (
        (a.outdir is None and not a.dry_run, "an output folder is needed, or --dry-run"),
        (a.since and a.until and a.since > a.until, "--since comes after --until"),
        (a.workers < 1, "--workers starts at 1"),
        (a.delete_source and not a.compress_source, "--delete-source goes with --compress-source"),
        (a.compress_source and a.dry_run, "a dry run compresses nothing"),
        (not 1 <= a.compress_level <= 10, "--compress-level is 1 to 10"),
        (a.dry_run and (a.incremental or a.prune), "a dry run neither adds nor prunes"),
    )
    return next((text for bad, text in rules if bad), None)


def summary(s, outdir) -> str:
    rows = [("Messages", f"{s.ok:,} {'to convert' if s.dry_run else 'converted'} ({s.body_html:,} HTML, {s.body_plain:,} plain)")]
    for n, text in ((s.skipped, "skipped by label"), (s.out_of_range, "outside the days asked for"), (s.already_converted, "in the output before"), (s.duplicate_message_ids_skipped, "further copies, labels merged"), (s.labels_updated, "with changed labels"), (s.errors, "failed"), (s.path_collisions, "that share a path with another")):
        if n:
            rows.append(("", f"{n:,} {text}"))
    if s.attachment_refs:
        saved = s.attachment_bytes_referenced - s.attachment_bytes_stored
        share = 100 * saved / s.attachment_bytes_referenced if s.attachment_bytes_referenced else 0
        rows.append(("Attachments", f"{s.unique_attachments:,} files, {readable(s.attachment_bytes_stored)}, of {s.attachment_refs:,} references; {readable(saved)} ({share:.0f}%) saved"))
    rows.append(("Markdown", readable(s.markdown_bytes)))
    if s.pruned or s.stale_files:
        rows.append(("Earlier runs", f"{s.pruned:,} files pruned" if s.pruned else f"{s.stale_files:,} files are stale; --prune deletes them"))
    took = s.elapsed_s
    speed = f", {s.processed / took:,.0f} mails a second" if took >= 0.1 else ""
    rows.append(("Time", f"{took:,.1f} s{speed}, {readable(s.bytes_total)} read"))
    head = "Dry run, nothing written" if s.dry_run else f"Done: {outdir}"
    return "\n".join([head, *(f"  {a:<13}{b}" for a, b in rows)])


def session(workers: int):
    from pyspark.sql import SparkSession

    b = SparkSession.builder.appName("maillake").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
    if not SparkSession.getActiveSession():
        b = b.master(f"local[{workers}]").config("spark.sql.shuffle.partitions", str(2 * workers))
    return b.getOrCreate()


def main(argv: list[str] | None = None, spark=None) -> int:
    p = parser()
    a = p.parse_args(argv)
    if text := _refusals(a):
        p.error(text)
    try:
        zone(a.tz)
    except ValueError as e:
        p.error(str(e))
    from maillake.plans.convert import convert
    from maillake.sources.mbox import compression_of

    if a.compress_source and a.mbox.is_file() and compression_of(a.mbox):
        p.error(f"{a.mbox} is compressed as it is")
    given = vars(a)
    options = ConvertOptions(**{f.name: given[f.name] for f in fields(ConvertOptions) if f.name in given}, unescape_from=not a.keep_from_escapes)
    say = lambda text: print(text, file=sys.stderr)
    failed: list[str] = []

    def on_error(path, error):
        failed.append(error)
        if a.verbose:
            say(f"failed: {error} ({path or 'no copy'})")

    try:
        stats = convert(spark or session(a.workers), a.mbox, a.outdir, options, on_error=on_error)
    except (ReadError, CompressionError, WorkerError) as e:
        say(f"error: {e}")
        return 1
    except KeyboardInterrupt:
        say("interrupted" if a.dry_run else f"interrupted; {a.outdir} may be incomplete")
        return 130
    if not a.quiet:
        text = json.dumps(stats.as_dict(), indent=2) if a.json else summary(stats, a.outdir)
        print(text)
    if failed and not (a.verbose or a.json):
        say(f"{len(failed):,} message(s) failed; --verbose names them")
    if a.compress_source:
        try:
            r = compress_mbox(a.mbox, level=a.compress_level, delete_source=a.delete_source, algorithm=a.compress_source)
        except CompressionError as e:
            say(f"error: {e}")
            return 1
        if not (a.quiet or a.json):
            say(f"{r.dest.name}: {readable(r.source_bytes)} in {readable(r.compressed_bytes)} ({r.ratio:.2f}x), verified" + ("; source deleted" if r.source_deleted else ""))
    return 0


if __name__ == "__main__":
    sys.exit(main())
