"""The scalar functions and the attachment table function, for Spark SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession, functions as F

from maillake.functions import text as T
from maillake.functions.files import ext_for
from maillake.ship import ship

_TEXT = {"html_to_md": T.html_to_md, "strip_quotes": T.strip_quotes, "tidy_whitespace": T.tidy_whitespace, "slugify": T.slugify}


def text_udf(name: str):
    """One of the text functions as an Arrow function of a string column; null stays null, but for slugs."""
    f = _TEXT[name]

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: f(x) if x is not None or name == "slugify" else None)

    return F.pandas_udf(run, "string")


def register(spark: SparkSession) -> None:
    """Make html_to_md, strip_quotes, tidy_whitespace, slugify, ext_for, mail_text and mbox_attachments callable from SQL."""
    ship(spark)
    for name in _TEXT:
        spark.udf.register(name, text_udf(name))

    def ext(name: pd.Series, kind: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([ext_for(n or "", k or "", d or b"") for n, k, d in zip(name, kind, data)])

    def body(raw: pd.Series) -> pd.Series:
        from maillake.functions.mime import parse
        from maillake.options import ConvertOptions

        o = ConvertOptions(skip_labels=frozenset())
        return raw.map(lambda r: None if r is None else parse(bytes(r), o)[1]["body"])

    spark.udf.register("ext_for", F.pandas_udf(ext, "string"))
    spark.udf.register("mail_text", F.pandas_udf(body, "string"))

    @F.udtf(returnType="pos int, name string, ext string, content_type string, size bigint, hash string, data binary")
    class Attachments:
        def eval(self, raw: bytes):
            from maillake.functions.mime import parse
            from maillake.options import ConvertOptions

            if raw is None:
                return
            for i, a in enumerate(parse(bytes(raw), ConvertOptions(skip_labels=frozenset()))[1]["attachments"]):
                yield i, a["name"], a["ext"], a["content_type"], a["size"], a["hash"], a["data"]

    spark.udtf.register("mbox_attachments", Attachments)
