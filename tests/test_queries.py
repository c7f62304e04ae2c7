import re

import pytest

from maillake.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(same, name):
    same(name)


def test_every_query_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert registry.QUERIES["q38_html_to_md"](spark, "/root/testdata/sf0.001").where("length(markdown) > 0").count() == 50


def test_labels_filter_below_the_parser(spark, tmp_path):
    from maillake.functions.mime import parse_messages
    from maillake.operators.mail import without_labels
    from maillake.plans.convert import with_headers
    from maillake.sources.mbox import read_mbox
    from tests import make_fixtures as fx

    (tmp_path / "m").write_bytes(fx.labels())
    rows = without_labels(with_headers(read_mbox(spark, tmp_path / "m")), frozenset({"Spam"}))
    plan = parse_messages(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Filter")


def test_duplicates_are_cut_before_the_shuffle(spark):
    from maillake.operators.mail import first_wins
    from maillake.plans.views import mail

    plan = first_wins(mail(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("WindowGroupLimit", plan)) >= 2


def test_readable_sizes_of_large_keys(spark, tmp_path):
    from maillake.cli import readable

    keys = [0, 11, 2_097_151, 2_097_152, 8_999_999, 2**63 - 1]
    spark.createDataFrame([(k,) for k in [*keys, None]], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.o_orderkey: r.shown for r in registry.QUERIES["q57_readable_sizes"](spark, str(tmp_path)).collect()}
    assert got == {k: readable(k**3 % 1700000000007) for k in keys}
