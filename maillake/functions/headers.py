"""Header projections of raw mail as native columns, so that they filter below the parser.

Raw bytes are read as ISO-8859-1, which keeps every byte. Java patterns carry the d flag: only a line
feed ends a line.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def latin(raw: Column) -> Column:
    return F.decode(raw, "ISO-8859-1")


def header_block(text: Column) -> Column:
    """What comes before the first blank line."""
    head = F.split(text, "\n\r?\n", 2)[0]
    return F.when(head == text, text).otherwise(F.regexp_replace(head, "\r+$", ""))


def message_id(head: Column) -> Column:
    """<id> of the first Message-ID header, or empty."""
    return F.regexp_extract(head, r"(?imd)^message-id:\s*(<[^>]{1,}>)", 1)


def message_key(head: Column) -> Column:
    """Hex key: SHA-1 of the Message-ID, or of the SHA-1 of the headers where there is none."""
    mid, octets = message_id(head), F.encode(head, "ISO-8859-1")
    return F.when(mid != "", F.sha1(F.encode(mid, "ISO-8859-1"))).otherwise(F.sha1(F.unhex(F.sha1(octets))))


def labels_value(head: Column) -> Column:
    """The first labels header with its folds, as text, bytes that are no UTF-8 replaced; null without one."""
    pattern = r"(?imd)^x-gmail-labels:[ \t]*([^\n]*(?:\n[\t ][^\n]*)*)"
    found = F.regexp_extract(head, pattern, 1)
    return F.when(head.rlike(pattern), F.make_valid_utf8(F.encode(found, "ISO-8859-1").cast("string")))


def labels(value: Column) -> Column:
    """Labels of a header value; none for null."""
    flat = F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " ")
    return F.filter(F.transform(F.split(flat, ","), lambda x: F.trim(x)), lambda x: x != "")


def encoded(value: Column) -> Column:
    """Whether a value has encoded words, which only the parser can read."""
    return F.coalesce(value.contains("=?"), F.lit(False))


def unescape_from(text: Column) -> Column:
    """Take one > off lines of >s and From."""
    return F.when(text.contains(">From "), F.regexp_replace(text, "(?md)^>(>*From )", "$1")).otherwise(text)


def skips(label_list: Column, skip: frozenset[str]) -> Column:
    return F.arrays_overlap(label_list, F.array(*[F.lit(x) for x in sorted(skip)])) if skip else F.lit(False)
