"""Mailboxes of our own in the shapes that mail clients and exports write. Only reserved domains appear."""

from __future__ import annotations

import base64
import hashlib
from datetime import datetime, timedelta, timezone
from email.message import EmailMessage
from email.policy import SMTP
from email.utils import format_datetime

START = datetime(2024, 1, 15, 9, 30, tzinfo=timezone.utc)


def filler(seed: str, n: int) -> bytes:
    block = base64.b64encode(hashlib.sha256(seed.encode()).digest()) + b"\n"
    return (block * (n // len(block) + 1))[:n]


def pdf(seed: str) -> bytes:
    return b"".join([b"%PDF-1.7 own\n", filler(seed, 2000)])


def png(seed: str, n: int) -> bytes:
    return (b"\x89PNG" + filler(seed, n))[:n]


def mail(name, n=None, subject="A message", when="auto", labels="Inbox", body="Plain text body.", html=None, files=(), cc=None, mid=True):
    m = EmailMessage(policy=SMTP)
    m["From"], m["To"] = "Alice Example <alice@example.com>", "carol@example.net, Bob Example <bob@example.org>"
    for field, value in {"Cc": cc, "Subject": subject, "X-Gmail-Labels": labels}.items():
        if value is not None:
            m[field] = value
    date = START + timedelta(hours=n or 0) if when == "auto" else when
    if date:
        m["Date"] = format_datetime(date)
    if mid:
        m["Message-ID"] = mid if isinstance(mid, str) else f"<{name}.{n}@fixtures.example.com>"
    m["X-GM-THRID"] = "1790000000000000001"
    texts = [(body, "plain"), (html, "html")]
    for k, (content, kind) in enumerate(x for x in texts if x[0] is not None):
        (m.add_alternative if k else m.set_content)(content, subtype=kind)
    for k, (fn, kind, data, *how) in enumerate(files):
        k or m.make_mixed()
        m.add_attachment(data, *kind.split("/"), filename=fn, disposition=how[0] if how else "attachment")
    for i, p in enumerate(x for x in m.walk() if x.is_multipart()):
        p.set_boundary(f"=====part-{i}==")
    return bytes(m)


def lines(*text: str) -> bytes:
    return b"".join(x.encode("latin-1") + b"\n" for x in text)


def box(*mails: bytes) -> bytes:
    out = b""
    for i, m in enumerate(mails):
        out += f"From {1780000000000000000 + i}@xxx Mon Jan 15 09:30:00 +0000 2024\n".encode() + m.rstrip() + b"\n\n"
    return out


def basic() -> bytes:
    b = "basic"
    return box(
        mail(b, 1, "Plain text only"),
        mail(b, 2, "HTML only", body=None, html="<p>Dear <b>Carol</b>: all <i>slanted</i>.</p>"),
        mail(b, 3, "Alternative", html="<p>As HTML.</p>", body="As plain text."),
        mail(b, 4, "Re: Fwd: RE: Quarterly plan (v2)!"),
        mail(b, 5, "Café résumé naïve"),
        mail(b, 6, "Weekly sync " * 12),
        mail(b, 7, "With Cc", cc="Dan Other <dan@example.com>"),
        mail(b, 8, "Reply quoting", body="Fine.\n\nOn Friday Eve wrote:\n> Lunch?\n> Eve"),
    )


def labels() -> bytes:
    b = "labels"
    folded = lines("From: alice@example.com", "Message-ID: <four@labels.example.com>", "Date: Tue, 16 Jan 2024 08:00:00 +0000", "X-Gmail-Labels: Inbox,", " Updates of kind,", "\tRead", "Subject: Folded", "", "Folded.")
    return box(
        mail(b, 1, "In the inbox", labels="Important,Inbox,Read"), mail(b, 2, "Spam message", labels="Spam"),
        mail(b, 3, "Trashed", labels="Read,Trash"), folded, mail(b, 5, "No labels header", labels=None),
        mail(b, 6, "Custom label", labels="Archived,Receipts/2024"),
        mail(b, 7, "First copy", mid="<labels.dup@fixtures.example.com>"), mail(b, 8, "Second copy", labels="Sent", mid="<labels.dup@fixtures.example.com>"),
        mail(b, 9, "Spam first", labels="Spam", mid="<labels.spam@fixtures.example.com>"), mail(b, 9, "Spam first", labels="Inbox,Starred", mid="<labels.spam@fixtures.example.com>"),
        mail(b, 10, "No id one", mid=False), mail(b, 11, "No id two", mid=False),
    )


def attachments() -> bytes:
    b, report = "attachments", pdf("report")
    inner = EmailMessage(policy=SMTP)
    inner["Subject"], inner["From"], inner["Message-ID"] = "The original", "alice@example.com", "<inner@fixtures.example.com>"
    inner.set_content("Forwarded body.")
    outer = EmailMessage(policy=SMTP)
    outer["Subject"], outer["From"], outer["Message-ID"], outer["Date"] = "Fwd: The original", "alice@example.com", "<outer@fixtures.example.com>", format_datetime(START)
    outer.set_content("See below.")
    outer.make_mixed()
    outer.add_attachment(inner)
    outer.set_boundary("=====outer==")
    return box(
        mail(b, 1, "Report", files=[("paper.pdf", "application/pdf", report)]),
        mail(b, 2, "Same bytes, new name", files=[("copy.pdf", "application/pdf", report)]),
        mail(b, 3, "Same bytes, odd suffix", files=[("paper.0ab1cd2e", "application/pdf", report)]),
        mail(b, 4, "Same name, new bytes", files=[("paper.pdf", "application/pdf", pdf("v2"))]),
        mail(b, 5, "Inline", html="<p>Two pictures.</p>", body=None, files=[(f"{n}.png", "image/png", png(n, k), how) for n, k, how in (("dot", 300, "inline"), ("photo", 11_000, "inline"), ("tiny", 200, "attachment"))]),
        mail(b, 6, "Unnamed", files=[(None, "application/octet-stream", pdf("anon"))]),
        mail(b, 7, "Path in name", files=[("../../etc/hosts", "text/plain", b"no real hosts\n")]),
        mail(b, 8, "Attachment only", files=[("list.txt", "text/plain", b"A file.\n")], body=None),
        mail(b, 9, "Calendar", files=[("invite.ics", "text/calendar", b"BEGIN:VCALENDAR\nEND:VCALENDAR\n")]),
        outer.as_bytes(policy=SMTP),
    )


def html() -> bytes:
    b = "html"
    letter = """<html><head>
<title>Window</title>
<style>.b{color:red}</style>
</head><body>
<table role="presentation" width=9>
<tr>
<td><p></p><table>
<tr>
<td><img src="x.png" alt="Picture"></td></tr>
</table>
<p></p>
<h1>News of May</h1>
<p>Begins.</p>
<p>Goes on at <a href="https://example.com/p/1">a page</a>.</p>
<p>Read <a href="../n.md">the notes</a>.</p>
</td></tr>
</table></body></html>"""
    receipt = "<table>\n<tr><th>What</th>\n<th>Cost</th></tr>\n<tr><td>Tea</td>\n<td>3</td></tr>\n</table>"
    odd = "<p>Hello&nbsp;&nbsp;&nbsp;world</p><p>&nbsp;</p><p>one<br>two</p><pre>keep    this</pre><ul><li>a</li><li>b</li></ul>"
    return box(
        mail(b, 1, "Newsletter", body=None, html=letter), mail(b, 2, "Receipt", body=None, html=receipt),
        mail(b, 3, "Unclosed head", body=None, html="<html><head><title>Tab</title><body><p>The message.</p></body></html>"),
        mail(b, 4, "Odd space", body=None, html=odd), mail(b, 5, "XHTML", body=None, html='<?xml version="1.0"?><html><body><p>X<br/>Y</p></body></html>'),
        mail(b, 6, "Blank plain", body="\n", html="<p>Only the HTML says it.</p>"),
    )


def encodings() -> bytes:
    head = lambda n, *more: [f"Message-ID: <enc.{n}@fixtures.example.com>", "From: alice@example.com", "Date: Mon, 15 Jan 2024 09:30:00 +0000", *more]
    west = timezone(timedelta(hours=-8))
    crlf = "\r\n".join([*head(11, "Subject: CRLF inside"), "", "Line one", "Line two", ""]).encode()
    return box(
        "\n".join([*head(1, "Subject: ünï 🎉", "X-Gmail-Labels: Été"), "", "ok", ""]).encode(),
        mail("enc", 2, "日本語の件名"),
        lines(*head(3, "Subject: Latin", "Content-Transfer-Encoding: quoted-printable", "Content-Type: text/plain; format=flowed; charset=iso-8859-1"), "", "caf=E9"),
        lines(*head(4, "Subject: Unknown one", "Content-Transfer-Encoding: 8bit", "Content-Type: text/plain; charset=unknown-8bit"), "", "caf\xe9"),
        lines(*head(5, "Subject: Unknown two", "Content-Transfer-Encoding: 8bit", "Content-Type: text/plain; charset=x-made-up"), "", "caf\xe9"),
        lines(*head(6, "Subject: =?utf-8?q?Encoded_w=C3=B6rd?=", "X-Gmail-Labels: =?utf-8?q?Caf=C3=A9?=,Inbox", "Content-Transfer-Encoding: base64", "Content-Type: text/plain; format=fixed; charset=utf-8"), "", base64.b64encode("Grüße".encode()).decode()),
        lines("Message-ID: <enc.7@fixtures.example.com>", "From: alice@example.com", "Subject: Bad date", "Date: soon", "", "x"),
        lines("Message-ID: <enc.8@fixtures.example.com>", "From: alice@example.com", "", "no subject, no date"),
        lines("Message-ID: <enc.9@fixtures.example.com>", "To: , ,x@example.com", "From: <<nobody@@example.com", "Subject: Bad addresses", "Date: Mon, 15 Jan 2024 09:30:00 +0000", "", "x"),
        mail("enc", 10, "West", when=datetime(2024, 1, 31, 23, 45, tzinfo=west)),
        crlf,
    )


def separators() -> bytes:
    a = mail("sep", 1, "From lines", body="From me to you\nFrom here\n")
    b = mail("sep", 2, "Escaped", body="x").replace(b"\r\nx\r\n", b"\r\n>From the start\r\n>>From twice\r\n> From no\r\n")
    c = mail("sep", 3, "No blank line", body="text\nFrom 1@xxx Mon Jan 15 09:30:00 +0000 2024\nmore")
    return box(a, b, c, mail("sep", 4, "Last"))


def mailclient() -> bytes:
    one = lines("From eve@example.net Fri Mar  1 08:15:00 2024", "Message-ID: <m1@example.com>", "Subject: One", "", ">From quoted", ">>From deeper", "")
    two = lines("From MAILER-DAEMON Mon Jan 15 09:30 2024", "Message-ID: <m2@example.com>", "Subject: Two", "", "bounce", "")
    return one + two + lines("From bob@example.org Mon Jan 15 09:30:00 EST 2024 remote from x", "Message-ID: <m3@example.com>", "Subject: Three", "", "zone")


def crlf() -> bytes:
    return b"\r\n".join(x.rstrip(b"\r") for x in box(mail("crlf", 1, "One"), mail("crlf", 2, "Two")).split(b"\n"))


ALL = {f.__name__: f for f in (basic, labels, attachments, html, encodings, separators, mailclient, crlf)} | {"empty": lambda: b""}
