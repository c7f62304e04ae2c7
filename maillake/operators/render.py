"""Message files as native columns: JSON scalars, YAML front matter, Markdown."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def scalar(v: Column) -> Column:
    """A string as JSON, which YAML reads too; null for null. Control characters have lower-case digits."""
    j = F.to_json(F.array(v))
    j = F.substring(j, F.lit(2), F.length(j) - 2)
    low = j
    for code in (0x0B, 0x0E, 0x0F, *range(0x1A, 0x20), 0x7F):
        # an escape follows an even number of backslashes; after an odd one the text itself has these characters
        low = F.regexp_replace(low, rf"(?<!\\)((?:\\\\)*)\\u{code:04X}", rf"$1\\u{code:04x}")
    j = F.when(j.contains("\\u00"), low).otherwise(j)
    return F.coalesce(F.when(v.isNull(), "null").otherwise(j), F.lit("null"))


def array(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(v, scalar), ", "), F.lit("]"))


def quoted(path: Column) -> Column:
    """A path percent-encoded, slashes kept."""
    s = F.url_encode(path)
    for a, b in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def attachment_line(a: Column, depth: Column) -> Column:
    link = F.concat(F.repeat(F.lit("../"), depth), quoted(a["path"]))
    return F.concat(F.lit("- ["), a["name"], F.lit("]("), link, F.lit(") ("), F.format_number(a["size"], 0), F.lit(" bytes)"))


def front_matter(m: dict[str, Column]) -> Column:
    """m: message_id, date, from, to, cc, subject, labels, thread_id, body_kind, paths."""
    one = lambda name, v: F.concat(F.lit(f"{name}: "), v)
    return F.concat_ws(
        "\n", F.lit("---"),
        one("message_id", scalar(m["message_id"])), one("date", scalar(m["date"])), one("from", scalar(m["from"])),
        one("to", array(m["to"])), one("cc", array(m["cc"])), one("subject", scalar(m["subject"])),
        one("labels", array(m["labels"])), one("thread_id", scalar(m["thread_id"])),
        one("body", scalar(F.coalesce(m["body_kind"], F.lit("none")))), one("attachments", array(m["paths"])), F.lit("---"),
    )


def document(m: dict[str, Column], body: Column, attachments: Column, depth: Column) -> Column:
    """A whole message file; attachments: array of (path, name, size)."""
    m = m | {"paths": F.transform(attachments, lambda a: a["path"])}
    or_else = lambda c, text: F.when(F.coalesce(c, F.lit("")) == "", text).otherwise(c)
    title = F.concat(F.lit("# "), or_else(m["subject"], "(no subject)"))
    listed = F.array_join(F.transform(attachments, lambda a: attachment_line(a, depth)), "\n")
    tail = F.when(F.size(attachments) > 0, F.concat(F.lit("\n\n## Attachments\n\n"), listed)).otherwise("")
    return F.concat(front_matter(m), F.lit("\n\n"), title, F.lit("\n\n"), or_else(body, "_(no body)_"), tail, F.lit("\n"))
