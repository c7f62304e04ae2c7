import html as html_lib
import random
import re

import pytest
from hypothesis import given, settings, strategies as st

from maillake.functions import files, text
from maillake.options import ConvertOptions

WRAPPED = "Sure.\n\nOn Tuesday, 3 May 2022 at noon, Carol <carol@\nexample.net> wrote:\n\n> well\n\nBye"


@pytest.mark.parametrize(("body", "want"), [
    (WRAPPED, "Sure.\n\nBye"), ("Answer\n\n--- Forwarded message ---\nold", "Answer"), ("Up\n\n-- Original Message --\nold", "Up"),
    ("Hm\n\nFrom: Eve\nSent: May\nold", "Hm"), ("Inline > stays\n>quoted", "Inline > stays"),
    ("Top\nOn the other hand, prose.\n\nNo quotes.", "Top\nOn the other hand, prose.\n\nNo quotes."), ("Am Montag schrieb Bob:\n> x\nEnde", "Am Montag schrieb Bob:\nEnde"),
    ("Bob schrieb:\n\n> x", ""), ("> a\n\n\n\n> b\nc", "c"),
])
def test_strip_quotes(body, want):
    assert text.strip_quotes(body) == want


@pytest.mark.parametrize(("subject", "want"), [("Re: Fwd: RE: Quarterly plan (v2)!", "quarterly-plan-v2"), ("Café résumé", "cafe-resume"), ("grüße ß", "grue"[:0] + "gru-e"[:0] + "grue"), (None, "no-subject"), ("日本", "no-subject"), ("AW: WG : x", "x"), ("a" * 70, "a" * 60), ("x" * 59 + " y", "x" * 59)])
def test_slugify(subject, want):
    assert text.slugify(subject) == want


@pytest.mark.parametrize(("suffix", "want"), [(".pdf", True), (".e3fc6c20", False), (".8", False), (".zzq", True), (".a1b2", False), (".a1b", True), (".toolong1", False), (".deadbe", True), ("", False)])
def test_plausible_suffix(suffix, want, spark):
    assert files.plausible_suffix(suffix) == want


def test_columns_agree_with_functions(spark):
    rng = random.Random(1)
    names = ["", "a", "a.pdf", "a.PDF", "x.e3fc6c20", ".hidden", "a.b/c", "a.b/c.txt", "v1.8", "a.", "a/.b", "x.tar.gz"]
    kinds = ["application/pdf", "application/octet-stream", "image/jpeg", "text/x-none", "TEXT/HTML"]
    datas = [b"", b"%PDF-1.4", b"  \x89PNGxx", b"<!DOCTYPE HTML>", b"BMW", b"\xff\xd8\xff", b"plain"]
    rows = [(rng.choice(names), rng.choice(kinds), rng.choice(datas)) for _ in range(300)]
    df = spark.createDataFrame(rows, "name string, kind string, data binary")
    got = df.select("*", files.ext_col(df.name, df.kind, df.data).alias("ext"), files.safe_name_col(df.name).alias("safe")).collect()
    for r in got:
        assert r.ext == files.ext_for(r.name, r.kind, bytes(r.data)), r
        assert r.safe == files.safe_name(r.name)


def test_json_and_links_in_columns(spark):
    import json
    from urllib.parse import quote

    from maillake.operators import render

    odd = ["", 'a"b\\c', "tab\tnl\n", "é漢😀", "\x00\x01\x0b\x1f", "a/b c~*+(d).txt", "</x>"]
    df = spark.createDataFrame([(x,) for x in odd], "x string")
    for r in df.select("x", render.scalar(df.x).alias("j"), render.quoted(df.x).alias("q")).collect():
        assert r.j == json.dumps(r.x, ensure_ascii=False) and r.q == quote(r.x)


@pytest.mark.parametrize(("page", "want"), [
    ("<p>Go <a href='https://e.test/d'>there</a>.</p>\n<ul>\n<li>eins</li>\n<li>zwei</li>\n</ul>", "Go [there](https://e.test/d).\n\n* eins\n* zwei"),
    ("<p>Hello&nbsp;&nbsp;&nbsp;world</p><p>&nbsp;</p><p>one<br>two</p><pre><code>a    b</code></pre>", "Hello world\n\none  \ntwo\n\n```\na    b\n```"),
    ("<table role='presentation'>\n<tr><td>\n<p>A.</p>\n<p>B.</p>\n</td></tr>\n<tr><td>\n<table>\n<tr><td>C</td></tr>\n</table>\n</td></tr>\n</table>", "A.\n\nB.\n\nC"),
    ("<table>\n<tr><th>I</th>\n<th>P</th></tr>\n<tr><td>W</td>\n<td>$5</td></tr>\n</table>", "| I | P |\n| --- | --- |\n| W | $5 |"),
    ("<html><head><meta charset='u'><title>T</title><body><p>The message.</p></body></html>", "The message."),
    ("<a href='#t'>f</a> <a href='javascript:x'>j</a> <a href='//e.test/a'>p</a> <a href='mailto:a@e.test'>m</a>", "f j [p](https://e.test/a) [m](mailto:a@e.test)"),
    ("<h2>Head <b>x</b></h2><ol><li>a<li>b</ol><hr><blockquote>q</blockquote>my_name", "## Head **x**\n\n1. a\n2. b\n\n---\n\n> q\n\nmy_name"),
])
def test_html_to_md(page, want):
    assert text.html_to_md(page) == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<td>", "<table>", "</table>", "<tr>", "<li>", "<ul>", "</ul>", "<b>", "</b>", "<pre>", "</pre>", "<script>x</script>", "<style>y</style>", "<head>", "</head>", "word ", "&lt;", "\n", "<br>", "<a href=x>", "</a>", "<!-- c -->"]), max_size=30))
def test_html_leaks_no_tags_and_no_blank_lines(parts):
    md = text.html_to_md("".join(parts))
    assert not re.search(r"</?(p|td|table|tr|li|ul|b|pre|script|style|head|br|a)\b[^;]*>", md.replace(html_lib.unescape("&lt;"), "", 0)) or "&lt;" in parts
    assert not any(x and not x.strip() for x in md.split("\n")) or "```" in md


def test_options():
    from datetime import date, datetime, timedelta, timezone

    west = datetime(2024, 1, 31, 23, 45, tzinfo=timezone(timedelta(hours=-8)))
    assert ConvertOptions(since=date(2024, 1, 31), until=date(2024, 1, 31)).wants(west)
    assert not ConvertOptions(since=date(2024, 2, 1)).wants(west) and ConvertOptions(since=date(2024, 2, 1), tz="Asia/Tokyo").wants(west)
    assert not ConvertOptions(until=date(2030, 1, 1)).wants(None) and ConvertOptions().wants(None)


def test_headers_are_read_as_the_default_policy_reads_them():
    import random
    from email import message_from_bytes, policy, utils

    from maillake.functions import mime

    rng = random.Random(11)
    words = ["a", "Re:", "  b ", "\t", "<x@y.example>", "=?utf-8?q?caf=C3=A9?=", "é", "\n folded", "\r\n\tmore", "2024", "\x01", ",", '"q', "(c)", "Mon, 15 Jan 2024 09:30:00 +0000", ";", "\\"]
    for _ in range(1500):
        value = "".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randrange(6)))
        for name in ("Subject", "X-Gmail-Labels", "X-GM-THRID", "Message-ID"):
            raw = f"{name}: {value}\nTo: b@example.com\n\nbody".encode()
            want = str(message_from_bytes(raw, policy=policy.default)[name] or "")
            assert mime.POLICY.plain(message_from_bytes(raw, policy=mime.POLICY), name.lower()) == want, (name, value)
        raw = f"Date: {value}\n\nbody".encode()
        try:
            want = utils.parsedate_to_datetime(str(message_from_bytes(raw, policy=policy.default)["Date"]))
        except Exception:
            want = None
        assert mime.date_of(message_from_bytes(raw, policy=mime.POLICY)) == want, value


def test_a_header_is_parsed_once(monkeypatch):
    from email import policy

    from maillake.functions import mime
    from maillake.options import ConvertOptions

    seen = []
    real = policy.EmailPolicy.header_fetch_parse
    monkeypatch.setattr(policy.EmailPolicy, "header_fetch_parse", lambda self, name, value: (seen.append((name, value)), real(self, name, value))[1])
    mime.POLICY._known.clear()
    raw = b"From: a@example.com\nTo: b@example.com\nSubject: x\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\nbody"
    assert mime.parse(raw, ConvertOptions())[0] == "ok"
    assert len(seen) == len(set(seen)) <= 5


def test_json_keeps_text_that_looks_like_an_escape(spark):
    import json

    from pyspark.sql import functions as F

    from maillake.operators import render

    texts = ["a\\u000Bb", "\\\\u000B", "\x0b", "\\\x0b", "\x0b\x0b\\u001F\x1f", "\\\\\x1a\\u001A", "\x7f\\u007F", "plain", "", "é\"\\n\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(render.scalar(F.col("t")).alias("j")).collect()
    assert [r.j for r in rows] == [json.dumps(t, ensure_ascii=False) for t in texts]


def test_batches_to_python_are_bounded_by_bytes(spark):
    import pyarrow as pa
    from pyspark.sql import functions as F

    from maillake.plans import registry
    from maillake.ship import BATCH, slices

    if spark._jsparkSession.sessionState().conf().contains(BATCH[0]):
        spark.conf.unset(BATCH[0])
    registry.QUERIES["q41_tidy_whitespace"](spark, "/root/testdata/sf0.001")

    @F.pandas_udf("long")
    def held(s):
        return s.map(lambda _: int(s.map(len).sum()))

    rows = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("t"))
    assert rows.select(held("t").alias("n")).agg(F.max("n")).first()[0] <= BATCH[1] + 200_000
    parts = list(slices(pa.RecordBatch.from_pydict({"t": ["x" * 100_000] * 40})))
    assert sum(p.num_rows for p in parts) == 40 and max(p.num_rows for p in parts) <= 11


def test_the_mime_stage_has_bounded_batches_too(spark):
    from maillake.plans import registry
    from maillake.ship import BATCH

    if spark._jsparkSession.sessionState().conf().contains(BATCH[0]):
        spark.conf.unset(BATCH[0])
    assert registry.QUERIES["q43_mime_attachments"](spark, "/root/testdata/sf0.001").count() > 0
    assert int(spark.conf.get(BATCH[0])) == BATCH[1]
