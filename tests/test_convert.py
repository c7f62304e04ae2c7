import gzip
import json
import re
from datetime import date
from pathlib import Path

import pytest

from maillake.operators import sinks
from maillake.options import ConvertOptions, ReadError, WorkerError
from maillake.plans.convert import convert
from tests import make_fixtures as fx


@pytest.fixture
def run(spark, tmp_path):
    def go(name, out="out", data=None, **options):
        src = tmp_path / f"{name}.mbox"
        src.write_bytes(fx.ALL[name]() if data is None else data)
        return convert(spark, src, tmp_path / out, ConvertOptions(**options)), tmp_path / out

    return go


def manifest(out: Path):
    return [json.loads(x) for x in (out / "messages.jsonl").read_text().splitlines()]


def page(out: Path, subject: str) -> str:
    m = next(m for m in manifest(out) if m["subject"] == subject)
    return (out / m["path"]).read_text()


def links_resolve(out: Path):
    for m in manifest(out):
        for link in re.findall(r"\((\.\.[^)]*)\)", (out / m["path"]).read_text()):
            assert ((out / m["path"]).parent / link).is_file()
        for a in m["attachments"]:
            assert (out / a["path"]).stat().st_size == a["size"]


def test_basic(run):
    s, out = run("basic")
    assert (s.ok, s.errors, s.body_plain, s.body_html) == (8, 0, 7, 1) and s.processed == 8
    assert "Dear **Carol**: all *slanted*." in page(out, "HTML only")
    assert "As plain text." in page(out, "Alternative")
    m = manifest(out)
    assert [x["subject"] for x in m][:2] == ["Plain text only", "HTML only"]
    assert m[3]["path"].startswith("2024/01/2024-01-15-1330-quarterly-plan-v2-")
    assert list(m[0]) == ["key", "path", "message_id", "date", "subject", "labels", "thread_id", "body", "attachments", "from"]
    text = page(out, "With Cc")
    assert 'cc: ["dan@example.com"]\n' in text and 'date: "2024-01-15T16:30:00+00:00"\n' in text
    assert 'to: ["carol@example.net", "bob@example.org"]\n' in text and text.endswith("Plain text body.\n")
    assert s.markdown_bytes == sum((out / x["path"]).stat().st_size for x in m)
    assert sorted((out / ".maillake-files").read_text().split("\n")[:-1]) == sorted(x["path"] for x in m)


def test_labels(run):
    s, out = run("labels")
    assert (s.ok, s.skipped, s.duplicate_message_ids_skipped, s.labels_updated) == (8, 3, 1, 1)
    by = {m["subject"]: m["labels"] for m in manifest(out)}
    assert by["First copy"] == ["Inbox", "Sent"] and by["Folded"] == ["Inbox", "Updates of kind", "Read"]
    assert by["No labels header"] == [] and by["Spam first"] == ["Inbox", "Starred"]
    assert 'labels: ["Inbox", "Sent"]' in page(out, "First copy")


@pytest.mark.parametrize(("skip", "ok", "skipped", "copies"), [((), 10, 0, 2), (("Important",), 9, 1, 2)])
def test_other_skip_lists(run, skip, ok, skipped, copies):
    s, _ = run("labels", skip_labels=frozenset(skip))
    assert (s.ok, s.skipped, s.duplicate_message_ids_skipped) == (ok, skipped, copies)


def test_attachments(run):
    s, out = run("attachments")
    assert (s.ok, s.errors) == (10, 0)
    links_resolve(out)
    by = {m["subject"]: m["attachments"] for m in manifest(out)}
    same = {a["path"] for k in ("Report", "Same bytes, new name", "Same bytes, odd suffix") for a in by[k]}
    assert len(same) == 1 and same.pop().endswith(".pdf")
    assert [a["name"] for a in by["Inline"]] == ["photo.png", "tiny.png"]
    assert by["Unnamed"][0]["name"] == "attachment.pdf" and by["Path in name"][0]["name"] == ".._.._etc_hosts"
    assert by["Fwd: The original"][0]["name"] == "The original.eml"
    index = [json.loads(x) for x in (out / "attachments/index.jsonl").read_text().splitlines()]
    assert len(index) == s.unique_attachments and sum(x["size"] for x in index) == s.attachment_bytes_stored
    assert max(len(x["messages"]) for x in index) == 3
    more, _ = run("attachments", "all", min_inline_image=0)
    assert more.attachment_refs == s.attachment_refs + 1


def test_html(run):
    s, out = run("html")
    assert (s.ok, s.body_html) == (6, 6)
    letter = page(out, "Newsletter")
    assert "# News of May" in letter and "[a page](https://example.com/p/1)" in letter and "Read the notes." in letter
    assert not any(x in letter for x in ("Window", "color", "Picture", "x.png", "|"))
    assert "| What | Cost |" in page(out, "Receipt") and "| Tea | 3 |" in page(out, "Receipt")
    odd = page(out, "Odd space")
    assert "Hello world" in odd and "one  \ntwo" in odd and "keep    this" in odd and "* a\n* b" in odd
    assert "Only the HTML says it." in page(out, "Blank plain") and "X  \nY" in page(out, "XHTML")


def test_encodings(run):
    s, out = run("encodings")
    assert (s.ok, s.errors) == (11, 0)
    assert "café" in page(out, "Latin") and "caf�" in page(out, "Unknown one") and "Grüße" in page(out, "Encoded wörd")
    by = {m["subject"]: m for m in manifest(out)}
    assert by["Encoded wörd"]["labels"] == ["Café", "Inbox"] and "<<nobody@@example.com" == by["Bad addresses"]["from"]
    assert by["Bad date"]["date"] is None and by[""]["path"].startswith("undated/undated-0000-no-subject-")
    assert by["West"]["path"].startswith("2024/01/2024-01-31-2345") and by["West"]["date"].endswith("-08:00")


@pytest.mark.parametrize(("tz", "n"), [("sender", 0), ("utc", 1), ("Asia/Tokyo", 1)])
def test_day_ranges(run, tz, n):
    s, _ = run("encodings", tz=tz, since=date(2024, 2, 1))
    assert s.ok == n and s.out_of_range == 11 - n


@pytest.mark.parametrize(("name", "n"), [("separators", 4), ("mailclient", 3), ("crlf", 2), ("empty", 0)])
def test_other_mailboxes(run, name, n):
    s, out = run(name)
    assert (s.ok, s.errors, s.processed) == (n, 0, n) and len(manifest(out)) == n
    if name == "separators":
        assert "From the start\n>From twice\n> From no" in page(out, "Escaped")


def test_incremental_runs(run):
    assert run("basic", limit=3)[0].ok == 3
    s, out = run("basic", incremental=True)
    assert (s.ok, s.already_converted) == (5, 3) and len(manifest(out)) == 8
    s, out = run("basic", incremental=True)
    assert (s.ok, s.already_converted, s.labels_updated) == (0, 8, 0) and len(manifest(out)) == 8
    changed = b"Labels: Archived".join(fx.basic().split(b"Labels: Inbox", 1))
    s, out = run("basic", incremental=True, data=changed)
    assert s.labels_updated == 1 and manifest(out)[0]["labels"] == ["Archived"]
    assert 'labels: ["Archived"]' in page(out, "Plain text only")


def test_torn_manifest(run):
    _, out = run("attachments", limit=4)
    (out / "attachments/index.jsonl").unlink()
    with open(out / "messages.jsonl", "a") as f:
        f.write('{"key": "torn')
    s, out = run("attachments", incremental=True)
    assert (s.ok, s.already_converted) == (6, 4) and len(manifest(out)) == 10
    links_resolve(out)


def test_prune(run):
    run("attachments")
    s, out = run("basic")
    assert s.stale_files > 10 and (out / "attachments").exists()
    (out / "own.txt").write_text("mine")
    s, out = run("basic", prune=True)
    assert s.pruned > 10 and (out / "own.txt").exists() and not list(out.rglob("*.pdf"))
    assert {p.relative_to(out).as_posix() for p in out.rglob("*.md")} == {m["path"] for m in manifest(out)}


def test_prune_stays_inside(tmp_path):
    out = tmp_path / "out"
    (out / "a").mkdir(parents=True)
    (out / "a/x").write_text("")
    (tmp_path / "secret").write_text("")
    assert sinks.prune(out, ["../secret", "a/x", "", "missing", str(tmp_path / "secret")]) == 1
    assert (tmp_path / "secret").exists() and not (out / "a").exists() and out.exists()


def test_dry_run_counts_what_a_run_would(run, tmp_path):
    for name in ("labels", "attachments"):
        dry, out = run(name, f"{name}-dry", dry_run=True)
        assert not out.exists()
        real, _ = run(name, f"{name}-real")
        skip = {"dry_run", "elapsed_s", "labels_updated"}
        assert {k: v for k, v in dry.as_dict().items() if k not in skip} == {k: v for k, v in real.as_dict().items() if k not in skip}


def test_one_bad_message_fails_alone(run, spark, monkeypatch):
    bad = fx.mail("bad", 2, "Broken").replace(b"Plain text body.", b"x").replace(b"Content-Type: text/plain; charset=\"utf-8\"", b"Content-Type: text/plain; charset=rot13")
    heard = []
    src_data = fx.box(fx.mail("bad", 1, "Fine"), bad)
    import tempfile

    d = Path(tempfile.mkdtemp())
    (d / "m").write_bytes(src_data)
    s = convert(spark, d / "m", d / "out", on_error=lambda p, e: heard.append((p, e)))
    assert s.ok + s.errors == 2 and s.ok >= 1
    if s.errors:
        assert (d / "out" / heard[0][0]).read_bytes() and json.loads((d / "out/_unparsed/errors.jsonl").read_text())["path"] == heard[0][0]


def test_gzip_input_and_missing_input(run, spark, tmp_path):
    s, _ = run("basic", data=gzip.compress(fx.basic()))
    assert s.ok == 8
    with pytest.raises(ReadError):
        convert(spark, tmp_path / "no", tmp_path / "out")
    with pytest.raises(ValueError):
        ConvertOptions(incremental=True, prune=True)
    with pytest.raises(ValueError):
        ConvertOptions(tz="Nowhere/Land")


def test_a_killed_run_is_resumed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "LOGGED", 1)
    data = fx.attachments()
    src, out = tmp_path / "x.mbox", tmp_path / "out"
    src.write_bytes(data)
    whole = convert(spark, src, tmp_path / "whole")
    last = manifest(tmp_path / "whole")[-1]["path"]
    (out / last).mkdir(parents=True)  # a folder where a message should go: the job fails after others are written
    with pytest.raises(WorkerError):
        convert(spark, src, out)
    assert not (out / "messages.jsonl").exists()
    left = len(list((out / ".maillake-parts").glob("*.jsonl")))
    assert 0 < left < whole.ok
    (out / last).rmdir()
    s = convert(spark, src, out, ConvertOptions(incremental=True))
    assert s.already_converted >= left and s.ok == whole.ok - left
    assert not (out / ".maillake-parts").exists()
    assert {m["key"]: m for m in manifest(out)} == {m["key"]: m for m in manifest(tmp_path / "whole")}
    assert (out / ".maillake-files").read_text() == (tmp_path / "whole" / ".maillake-files").read_text()
    links_resolve(out)


def test_a_damaged_header_does_not_end_the_run(run):
    names = ["From", "To", "Cc", "Subject", "Date", "Message-ID", "X-Gmail-Labels", "X-GM-THRID", "Content-Type"]
    mail = b"From: a@example.com\nMessage-ID: <1@example.com>\nSubject: fine\n\nbody"
    odd = [b"From: b@example.com\nX-No: %d\n" % i + n.encode() + b": Caf\xe9,Inbox\n\nbody" for i, n in enumerate(names)]
    s, out = run("damaged", data=fx.box(mail, *odd, mail.replace(b"<1@", b"<2@")))
    assert s.ok + s.errors == len(names) + 2 and s.ok >= 2
    assert ["Caf�", "Inbox"] in [m["labels"] for m in manifest(out)]


def test_raw_mail_and_attachments_are_not_shuffled(spark, tmp_path):
    from maillake.plans.convert import with_headers
    from maillake.sources.mbox import read_mbox

    (tmp_path / "m").write_bytes(fx.labels())
    rows = with_headers(read_mbox(spark, tmp_path / "m", places=True, split_bytes=700))
    kept = read_mbox(spark, tmp_path / "m", split_bytes=700, drop=rows.where("ordinal % 2 = 0").select("file", "start", "ordinal"))
    assert all(r.ordinal % 2 for r in kept.collect()) and kept.count() == (rows.count() + 1) // 2
    plan = kept._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("MapInArrow")]
    assert "Exchange" not in above and "Join" not in above


def test_limit_reports_the_bytes_it_read(run):
    s, _ = run("basic", limit=2)
    assert 0 < s.bytes_read < s.bytes_total
    assert run("basic", out="all")[0].bytes_read == s.bytes_total


def test_one_message_and_the_table(spark, tmp_path):
    import maillake

    (tmp_path / "m").write_bytes(fx.basic())
    raws = list(maillake.iter_messages(tmp_path / "m"))
    rows = [maillake.parse_message(r) for r in raws]
    assert len(rows) == 8 and rows[0].subject == "Plain text only" and isinstance(rows[0], maillake.ParsedMessage)
    assert maillake.parse_message(b"X-Gmail-Labels: Spam\n\nx") is None
    msgs = maillake.parse_messages(maillake.read_mbox(spark, tmp_path / "m"), keep_data=False).where("status = 'ok'").select("msg.*")
    maillake.write_tables(msgs, str(tmp_path / "table"))
    back = spark.read.parquet(str(tmp_path / "table"))
    assert back.count() == 8 and {(r.year, r.month) for r in back.collect()} <= {(2024, 1), (None, None)}
    assert set(maillake.__all__) <= set(dir(maillake)) | {n for n in maillake.__all__ if getattr(maillake, n)}


def test_progress_is_heard_while_messages_are_parsed(spark, tmp_path):
    (tmp_path / "m").write_bytes(fx.attachments())
    heard = []
    s = convert(spark, tmp_path / "m", tmp_path / "out", on_progress=lambda x: heard.append((x.ok, x.elapsed_s)))
    assert len(heard) > 4 and max(n for n, _ in heard) == s.ok == 10 and [t for _, t in heard] == sorted(t for _, t in heard)


def test_any_function_maps_messages(spark, tmp_path):
    import maillake

    (tmp_path / "m").write_bytes(fx.basic())

    def work(raw):
        if b"HTML only" in raw:
            raise ValueError("not this one")
        return {"n": len(raw), "subject": raw.split(b"Subject: ")[1].split(b"\r\n")[0].decode()} if b"Cc: " in raw else None

    rows = maillake.map_messages(maillake.read_mbox(spark, tmp_path / "m"), work, "n: bigint, subject: string").collect()
    assert len(rows) == 8 and sum(r.error is not None for r in rows) == 1 and "not this one" in "".join(r.error or "" for r in rows)
    assert [r.out.subject for r in rows if r.out] == ["With Cc"]
