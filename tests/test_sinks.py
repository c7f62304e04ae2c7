"""Whole files that many tasks write."""

from pyspark import TaskContext
from pyspark.sql import functions as F

from maillake.operators import sinks


def test_one_mailbox_is_written_by_many_tasks(spark, tmp_path):
    from maillake.plans.evidence import write_boxes
    from maillake.sources.mbox import iter_messages

    rows = spark.range(2000).select((F.col("id") % 2).alias("box"), (-F.col("id")).alias("ordinal"), F.concat(F.lit("m"), "id", F.lit("\n\nFrom x")).alias("raw"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = write_boxes(rows, tmp_path)
        task = lambda r: f"{TaskContext.get().partitionId()} {r['ordinal']}\n".encode()
        sinks.write_whole(rows.select("ordinal"), tmp_path, ["ordinal"], task, name="a/tasks")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [p.name for p in made] == ["00.mbox", "01.mbox"]
    for k, path in enumerate(made):
        assert list(iter_messages(path)) == [b"m%d\n\nFrom x\n\n" % i for i in range(1998 + k, -1, -2)]
    lines = [x.split() for x in (tmp_path / "a/tasks").read_text().splitlines()]
    assert [int(n) for _, n in lines] == list(range(-1999, 1)) and len({t for t, _ in lines}) > 1
    assert sorted(p.name for p in tmp_path.iterdir()) == ["00.mbox", "01.mbox", "a"]


def test_a_file_without_rows_is_there_and_old_ones_are_replaced(spark, tmp_path):
    (tmp_path / "x").write_text("old")
    rows = spark.createDataFrame([(2, "é"), (1, None)], "n int, s string")
    sinks.write_whole(rows, tmp_path, ["n"], sinks.line, name="x")
    sinks.write_whole(rows.where("n > 2"), tmp_path, ["n"], sinks.line, name="y")
    assert (tmp_path / "x").read_text() == '{"n": 1, "s": null}\n{"n": 2, "s": "é"}\n' and (tmp_path / "y").read_bytes() == b""
    assert sorted(p.name for p in tmp_path.iterdir()) == ["x", "y"]


def test_no_path_of_earlier_runs_passes_the_driver(spark, monkeypatch):
    from pyspark.sql import DataFrame

    from maillake.plans import registry

    def refused(*_):
        raise AssertionError("rows are streamed through the driver")

    monkeypatch.setattr(DataFrame, "toLocalIterator", refused)
    found = registry.QUERIES["q54_previous_outputs"](spark, "/root/testdata/sf0.001")
    assert found.where("path like 'mail/%'").count() == 200 and registry.QUERIES["q53_manifest"](spark, "/root/testdata/sf0.001").count() > 0
