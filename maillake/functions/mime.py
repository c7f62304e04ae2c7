"""The one Python stage: raw mail to nested columns, on Arrow batches, with the standard library's parser."""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from email import header, message_from_bytes, policy, utils
from email.message import EmailMessage, Message

import pyarrow as pa
from pyspark.sql import DataFrame

from maillake.functions.files import address, ext_for, relpath, safe_name
from maillake.functions.text import html_to_md, squeeze_lines, strip_quotes
from maillake.options import ConvertOptions
from maillake.schemas import PARSED
from maillake.ship import slices

class _Policy(policy.EmailPolicy):
    """The default policy, but a header that was parsed before, in this message or another, isn't parsed again.

    The standard library parses a header at every look-up. Plain unstructured ones need no parser at all.
    """

    _known: dict = {}
    _PLAIN = re.compile(r"[ -~\t]*")
    _PLAIN_ID = re.compile(r"<[A-Za-z0-9_+-]+(\.[A-Za-z0-9_+-]+)*@[A-Za-z0-9_+-]+(\.[A-Za-z0-9_+-]+)*>")

    def header_fetch_parse(self, name, value):
        if hasattr(value, "name"):
            return value
        key = name, value
        found = self._known.get(key)
        if found is None:
            found = super().header_fetch_parse(name, value)
            if len(self._known) >= 2048:
                self._known.clear()
            if len(value) <= 1000:
                self._known[key] = found
        return found

    def plain(self, mail: Message, name: str) -> str:
        """The text of an unstructured header, a date or a message id, empty without one."""
        whole = self._PLAIN_ID if name == "message-id" else self._PLAIN
        for k, v in mail._headers:
            if k.lower() == name and isinstance(v, str):
                flat = "".join(v.splitlines()) if "\n" in v or "\r" in v else v
                if "=?" not in flat and whole.fullmatch(flat):
                    return flat
                break
        return str(mail[name] or "")


POLICY = _Policy()

_MID = re.compile(rb"^message-id:\s*(<[^>]{1,}>)", re.M | re.I)


def clean(s: str) -> str:
    """Without lone surrogates, which no column can hold."""
    return s.encode("utf-8", "replace").decode() if not s.isascii() else s


def head_of(raw: bytes) -> bytes:
    end = re.search(rb"\n\r?\n", raw)
    return raw if end is None else raw[: end.start()].rstrip(b"\r")


def key_bytes(raw: bytes) -> bytes:
    head = head_of(raw)
    found = _MID.search(head)
    return found[1] if found else hashlib.sha1(head).digest()


def _flat(value: str) -> str:
    """White space as single spaces, the ends kept."""
    return re.sub(r"\s\s*", " ", value)


def decode_labels(value: str) -> list[str]:
    """Labels of a header value that may hold encoded words; unknown charsets are read leniently."""
    if "=?" in value:
        words = []
        for part, charset in header.decode_header(value):
            if isinstance(part, bytes):
                try:
                    part = part.decode(charset or "ascii", "replace")
                except LookupError:
                    part = part.decode("utf-8", "replace")
            words.append(part)
        value = "".join(words)
    return list(filter(None, map(str.strip, _flat(value).split(","))))


def _codec(name: str | None) -> str:
    try:
        return codecs.lookup(name or "utf-8").name
    except LookupError:
        return "utf-8"


def text_of(part: Message) -> str:
    """The text of a part; what its charset cannot tell is replaced, an unknown charset is taken for UTF-8."""
    try:
        content = part.get_content()
    except Exception:
        content = None
    if isinstance(content, str):
        return content
    data = part.get_payload(decode=True)
    return (data if isinstance(data, bytes) else b"").decode(_codec(part.get_content_charset()), "replace")


def body_of(mail: EmailMessage, most: int) -> tuple[str, str | None, Message | None]:
    """(Markdown, kind, part): plain text if there is any that isn't blank, else HTML."""
    part = mail.get_body(("plain", "html"))
    if part is None:
        return "", None, None
    html = part if part.get_content_subtype() == "html" else None
    text = "" if html is not None else text_of(part)
    if html is None and not text.strip():
        html = mail.get_body(("html",))
    if html is None:
        return squeeze_lines(text), "plain", part
    return squeeze_lines(html_to_md(text_of(html), most)), "html", part


def leaves(part: Message) -> Iterator[Message]:
    """Parts that hold no others, in order; an attached mail is one of them."""
    if part.is_multipart() and part.get_content_type() != "message/rfc822":
        for p in part.get_payload():
            if isinstance(p, Message):
                yield from leaves(p)
    else:
        yield part


def attachments_of(mail: EmailMessage, body: Message | None, smallest: int) -> Iterator[dict]:
    for p in leaves(mail):
        kind, name, how = p.get_content_type(), p.get_filename(), p.get_content_disposition()
        if p is body or (kind in {"text/plain", "text/html"} and how != "attachment" and not name):
            continue
        if kind == "message/rfc822":
            inner = next(iter(p.get_payload()), None) if isinstance(p.get_payload(), list) else None
            if not isinstance(inner, Message):
                continue
            data, ext = inner.as_bytes(policy=policy.compat32), ".eml"
            title = (str(inner["Subject"]).strip() if inner["Subject"] else "") or "forwarded-message"
            label = safe_name(str(name)) if name else safe_name(title) + ext
        else:
            data = p.get_payload(decode=True)
            if not data or not isinstance(data, bytes):
                continue
            if how != "attachment" and len(data) < smallest and kind.startswith("image/"):
                continue
            ext = ext_for(str(name or ""), kind, data)
            label = safe_name(str(name)) if name else f"attachment{ext}"
        yield {"name": clean(label), "ext": clean(ext), "content_type": clean(kind), "hash": address(data, ext)[0], "size": len(data), "data": data}


def addresses(mail: EmailMessage, name: str) -> list[str]:
    value = mail[name]
    return [clean(a) for _, a in utils.getaddresses([str(value)])] if value else []


def sender_of(mail: EmailMessage) -> str:
    """From as parsed; as written where parsing found faults and lost the address."""
    value = mail["From"]
    text = "" if value is None else str(value)
    if value is not None and "@" not in text and getattr(value, "defects", ()):
        written = next((str(v) for k, v in mail.raw_items() if k.lower() == "from"), text)
        return " ".join(x.strip() for x in written.split("\n")).strip()
    return text


def date_of(mail: EmailMessage) -> datetime | None:
    try:
        return utils.parsedate_to_datetime(POLICY.plain(mail, "date"))
    except Exception:
        return None


def parse(raw: bytes, options: ConvertOptions) -> tuple[str, dict | None]:
    """(status, message): ok, label or date."""
    mail = message_from_bytes(raw, policy=POLICY)
    labels = [clean(x) for x in filter(None, map(str.strip, _flat(POLICY.plain(mail, "x-gmail-labels")).split(",")))]
    if not options.skip_labels.isdisjoint(labels):
        return "label", None
    when = date_of(mail)
    if not options.wants(when):
        return "date", None
    body, kind, part = body_of(mail, options.max_html)
    here = options.local(when)
    key, subject = hashlib.sha1(key_bytes(raw)).hexdigest(), POLICY.plain(mail, "subject")
    return "ok", {
        "key": key,
        "path": relpath(here, subject, key),
        "message_id": clean(POLICY.plain(mail, "message-id").strip()),
        "date_iso": when.isoformat() if when else None,
        "date_utc": (when if when.tzinfo else when.replace(tzinfo=timezone.utc)).astimezone(timezone.utc) if when else None,
        "offset_s": int(when.utcoffset().total_seconds()) if when and when.tzinfo else None,
        "local_ts": here.replace(tzinfo=timezone.utc) if here else None,  # the clock's reading, as if it were UTC
        "sender": clean(sender_of(mail)),
        "to": addresses(mail, "To"),
        "cc": addresses(mail, "Cc"),
        "subject": clean(subject),
        "labels": labels,
        "thread_id": clean(POLICY.plain(mail, "x-gm-thrid")) or None,
        "body": clean(strip_quotes(body) if options.strip_quotes else body),
        "body_kind": kind,
        "attachments": list(attachments_of(mail, part, options.min_inline_image)),
    }


@dataclass(frozen=True)
class AttachmentPart:
    """One attachment of a message."""

    name: str
    ext: str
    content_type: str
    hash: str
    size: int
    data: bytes | None


@dataclass(frozen=True)
class ParsedMessage:
    """One message, with the fields of the column `msg`."""

    key: str
    path: str
    message_id: str
    date_iso: str | None
    date_utc: datetime | None
    offset_s: int | None
    local_ts: datetime | None
    sender: str
    to: list[str]
    cc: list[str]
    subject: str
    labels: list[str]
    thread_id: str | None
    body: str
    body_kind: str | None
    attachments: list[AttachmentPart]


def parse_message(raw: bytes, options: ConvertOptions | None = None) -> ParsedMessage | None:
    """One raw message, in this process; None if the options leave it out. Raises what the parser raises."""
    _, found = parse(raw, options or ConvertOptions())
    return None if found is None else ParsedMessage(**found | {"attachments": [AttachmentPart(**a) for a in found["attachments"]]})


def map_messages(messages: DataFrame, work: Callable[[bytes], dict | None], schema: str) -> DataFrame:
    """(file, ordinal, error, out) of (file, ordinal, raw): work(raw) as a struct of `schema`, null where it returns None.

    A message on which work fails is an error row and never fails the rest.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = f"file string, ordinal bigint, error string, out struct<{schema}>"
    arrow = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 64):
                rows = []
                for r in part.to_pylist():
                    row = {"file": r["file"], "ordinal": r["ordinal"], "error": None, "out": None}
                    try:
                        row["out"] = work(r["raw"] or b"")
                    except Exception as e:
                        row["error"] = clean(repr(e))
                    rows.append(row)
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return messages.select("file", "ordinal", "raw").mapInArrow(run, ddl)


def _schema() -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(PARSED))


def parse_messages(messages: DataFrame, options: ConvertOptions = ConvertOptions(), keep_data: bool = True, seen=None) -> DataFrame:
    """Parse (file, ordinal, raw): status is ok, label, date or error; one bad message never fails the rest.

    Without `keep_data` attachment bytes are hashed and left behind. `seen`, an accumulator, counts the messages as tasks end.
    """

    schema = _schema()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for r in (x for part in slices(batch) for x in part.to_pylist()):
                raw = r["raw"] or b""
                mid = key_bytes(raw)
                row = {
                    "file": r["file"], "ordinal": r["ordinal"], "key": hashlib.sha1(mid).hexdigest(), "error": None,
                    "message_id": clean(mid.decode(errors="replace")) if mid[:1] == b"<" else "",
                }
                try:
                    row["status"], row["msg"] = parse(raw, options)
                except Exception as e:
                    row |= {"status": "error", "error": clean(repr(e)), "msg": None}
                if row["msg"] and not keep_data:
                    for a in row["msg"]["attachments"]:
                        a["data"] = None
                rows.append(row)
                size += len(raw)
                if seen is not None:
                    seen.add(1)
                if len(rows) == 64 or size > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return messages.select("file", "ordinal", "raw").mapInArrow(run, PARSED)
