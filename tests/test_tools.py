import argparse
import json
from collections import Counter

import pytest

from maillake import cli, compress
from maillake.options import CompressionError
from maillake.sources import mbox
from tests import make_fixtures as fx


@pytest.mark.parametrize("algorithm", ["zstd", "gzip"])
def test_compression_is_verified(spark, tmp_path, algorithm):
    src = tmp_path / "a.mbox"
    src.write_bytes(fx.attachments())
    seen = []
    r = compress.compress_mbox(src, algorithm=algorithm, level=9, on_progress=lambda *x: seen.append(x[0]))
    assert r.ratio > 1 and src.exists() and {"compress", "verify"} <= set(seen) and not list(tmp_path.glob(".*"))
    assert mbox.read_mbox(spark, r.dest).count() == 10
    for bad in (src, r.dest):
        with pytest.raises(CompressionError):
            compress.compress_mbox(bad, algorithm=algorithm)
    again = compress.compress_mbox(src, algorithm=algorithm, overwrite=True, delete_source=True)
    assert again.source_deleted and not src.exists()


def test_a_copy_that_differs_is_refused(tmp_path, monkeypatch):
    src = tmp_path / "a"
    src.write_bytes(b"text" * 1000)
    import io

    monkeypatch.setattr(compress, "open_plain", lambda *_: io.BytesIO(b"other"))
    with pytest.raises(CompressionError):
        compress.compress_mbox(src, delete_source=True)
    assert src.exists() and [p.name for p in tmp_path.iterdir()] == ["a"]


@pytest.mark.parametrize(("text", "n"), [("2MiB", 2 << 20), ("0", 0), ("6KB", 6144), ("1.5 MB", 1572864), ("3b", 3), ("6k", 6144), ("7", 7)])
def test_sizes(text, n):
    assert cli.size_of(text) == n


def test_literals():
    for bad in ("x", "5 GB", "-1"):
        with pytest.raises(argparse.ArgumentTypeError):
            cli.size_of(bad)
    with pytest.raises(argparse.ArgumentTypeError):
        cli.day_of("2024-13-01")
    assert cli.labels_of(" a, ,b ") == {"a", "b"}
    assert [cli.readable(n) for n in (0, 999, 1500, 2_500_000, 3e12)] == ["0 B", "999 B", "1.5 KB", "2.5 MB", "3,000.0 GB"]


@pytest.mark.parametrize("argv", [["m"], ["m", "o", "--until", "2023-05-01", "--since", "2023-06-01"], ["m", "o", "--workers", "0"], ["m", "o", "--delete-source"], ["m", "--dry-run", "--prune"], ["m", "--dry-run", "--compress-source", "gzip"], ["m", "o", "--compress-level", "11", "--compress-source", "gzip"], ["m", "o", "--tz", "No/Where"], ["m", "o", "--prune", "--incremental"], ["m", "o", "-q", "--json"]])
def test_refused_arguments(argv):
    with pytest.raises(SystemExit) as e:
        cli.main(argv)
    assert e.value.code == 2


def test_command_line(spark, tmp_path, capsys):
    src = tmp_path / "m.mbox"
    src.write_bytes(fx.basic())
    assert cli.main([str(src), f"{tmp_path}/out", "--limit", "4", "--json"], spark) == 0
    assert (said := capsys.readouterr().out) and json.loads(said)["ok"] == 4
    assert cli.main([str(src), "--dry-run"], spark) == 0
    assert "8 to convert (1 HTML, 7 plain)" in capsys.readouterr().out
    assert cli.main([str(tmp_path / "none"), str(tmp_path / "o2")], spark) == 1
    assert "error" in capsys.readouterr().err


def test_sql_functions(spark):
    from maillake.functions.sql import register

    register(spark)
    raw = fx.mail("s", 1, "Two", files=[("b.pdf", "application/pdf", b"two"), ("a.md", "text/markdown", b"one")])
    spark.createDataFrame([(1, raw)], "id int, raw binary").createOrReplaceTempView("mails")
    r = spark.sql("SELECT slugify('Re: Ä b'), html_to_md('<b>x</b>'), strip_quotes('a\n> b'), ext_for('a', 'application/pdf', X''), mail_text(raw) FROM mails").first()
    assert tuple(r) == ("a-b", "**x**", "a", ".pdf", "Plain text body.")
    rows = spark.sql("SELECT id, a.name, a.size FROM mails, LATERAL mbox_attachments(raw) a ORDER BY a.pos").collect()
    assert [tuple(x) for x in rows] == [(1, "b.pdf", 3), (1, "a.md", 3)]


def test_stream_keeps_one_message_a_key(spark, tmp_path):
    from maillake.streaming import ingest

    box, table, state = tmp_path / "new", str(tmp_path / "table"), str(tmp_path / "state")
    box.mkdir()
    for i, raw in enumerate(mbox.split(fx.labels())):
        (box / f"{i}.eml").write_bytes(raw)
    for _ in range(2):
        ingest.ingest(ingest.raw_stream(spark, str(box)), table, state).awaitTermination()
        rows = ingest.current(spark, table).collect()
        assert len(rows) == 8 and max(Counter(r.key for r in rows).values()) == 1
    (box / "again.eml").write_bytes(fx.mail("labels", 1, "In the inbox"))
    (box / "new.eml").write_bytes(fx.mail("more", 1, "New"))
    ingest.ingest(ingest.raw_stream(spark, str(box)), table, state).awaitTermination()
    assert ingest.current(spark, table).count() == 9


def test_stream_appends_merges_parts_and_ignores_retries(spark, tmp_path, monkeypatch):
    from maillake.options import ConvertOptions
    from maillake.streaming import ingest

    monkeypatch.setattr(ingest, "FAN", 2)
    table, options = str(tmp_path / "table"), ConvertOptions()
    (tmp_path / "table").mkdir()
    batches = [spark.createDataFrame([("f", k, fx.mail("m", k, f"No {k}")) for k in ks], "file string, ordinal long, raw binary") for ks in ((1, 2), (2, 3), (3,), (4,))]
    for i, b in enumerate(batches):
        ingest.merge(b, i, table, options)
        ingest.merge(b, i, table, options)  # a retry
        names = [n for n, _ in ingest._pointer(table)["parts"]]
        assert ingest.current(spark, table).count() == len({r.key for r in ingest.current(spark, table).collect()}) == min(i + 2, 3) + (i == 3)
    assert names and {p.name for p in (tmp_path / "table").iterdir() if p.is_dir()} <= set(names) | set(ingest._pointer(table)["left"])
    assert [level for _, level in ingest._pointer(table)["parts"]] == [2]


def test_a_batch_of_one_split_is_parsed_by_many_tasks(spark):
    from maillake.streaming import ingest

    batch = spark.createDataFrame([("f", k, fx.mail("m", k, f"No {k}")) for k in range(40)], "file string, ordinal long, raw binary").coalesce(1)
    per_task = ingest.spread(batch).rdd.glom().map(len).collect()
    assert sum(per_task) == 40 and max(per_task) <= 40 // spark.sparkContext.defaultParallelism + 1
