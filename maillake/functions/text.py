"""Text of mails: HTML to Markdown, white space, quoted replies, slugs. Plain functions on strings."""

from __future__ import annotations

import re
import unicodedata
from html.parser import HTMLParser
from urllib.parse import urlsplit

NBSP = "\N{NO-BREAK SPACE}"
_DROPPED = {"base", "link", "meta", "noscript", "script", "style", "template", "title"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCKS = {"p", "div", "section", "article", "header", "footer", "main", "nav", "aside", "form", "fieldset", "center", "address", "figure", "figcaption", "dl", "dd", "dt", "body", "html", "head", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "details", "summary"}
_CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
_SCOPES = {"li": {"ul", "ol"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "p": {"div", "td", "th", "li", "table", "blockquote", "body"}}
_STRONG, _EMPH, _CODE = {"b", "strong"}, {"i", "em"}, {"code", "kbd", "samp", "tt"}
CELL = 100


class Node:
    __slots__ = ("tag", "attrs", "kids", "up")

    def __init__(self, tag: str, attrs: dict, up):
        self.tag, self.attrs, self.kids, self.up = tag, attrs, [], up

    def walk(self):
        todo = list(reversed(self.kids))
        while todo:
            k = todo.pop()
            if isinstance(k, Node):
                yield k
                todo += reversed(k.kids)

    def text(self) -> str:
        out, todo = [], list(reversed(self.kids))
        while todo:
            k = todo.pop()
            if isinstance(k, str):
                out.append(k)
            else:
                todo += reversed(k.kids)
        return "".join(out)


class _Tree(HTMLParser):
    """A tolerant tree of a page, without the tags whose content nobody reads."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("root", {}, None)
        self.silent: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in _DROPPED:
            if tag not in _VOID:
                self.silent.append(tag)
            return
        if self.silent or tag == "head":  # head is transparent: it may never end
            return
        closes, scope = _CLOSES.get(tag), _SCOPES.get(tag, set())
        if closes:
            n = self.now
            while n.up and n.tag not in scope:
                if n.tag in closes:
                    self.now = n.up
                    if tag != "tr":
                        break
                n = n.up
        node = Node(tag, dict(attrs), self.now)
        self.now.kids.append(node)
        if tag not in _VOID:
            self.now = node

    def handle_startendtag(self, tag, attrs):
        if tag in _DROPPED or self.silent or tag == "head":
            return
        self.now.kids.append(Node(tag, dict(attrs), self.now))

    def handle_endtag(self, tag):
        if tag in _DROPPED:
            if tag in self.silent:
                del self.silent[self.silent.index(tag) :]
            return
        if self.silent:
            return
        n = self.now
        while n.up and n.tag != tag:
            n = n.up
        if n.up:
            self.now = n.up

    def handle_data(self, data):
        if not self.silent:
            self.now.kids.append(data)


def link_target(href: str | None) -> str | None:
    """Where a link leads outside its page, or None if nowhere: no scheme, a fragment, a script."""
    href = (href or "").strip()
    if href.startswith("//"):
        return "https:" + href
    try:
        scheme = urlsplit(href).scheme.lower()
    except ValueError:
        return None
    return href if scheme and scheme != "javascript" else None


def _rows(table: Node) -> list[Node]:
    return [n for n in table.walk() if n.tag == "tr"]


def is_data_table(table: Node) -> bool:
    """A small flat grid, as opposed to a table that only places things."""
    inside = list(table.walk())
    if table.attrs.get("role") == "presentation" or any(n.tag == "table" for n in inside):
        return False
    if any(n.tag == "th" for n in inside):
        return True
    rows = [[c for c in r.walk() if c.tag in ("td", "th")] for r in _rows(table)]
    small = lambda c: len("".join(x.strip() for x in c.text().split("\n"))) <= CELL
    flat = lambda c: not any(n.tag in ("br", "div", "ol", "p", "ul") for n in c.walk())
    return len(rows) > 1 and all(len(r) > 1 and all(small(c) and flat(c) for c in r) for r in rows)


class _Writer:
    """Markdown of a tree: ATX headings, * bullets, no images, underscores as they are."""

    def inline(self, node: Node) -> str:
        return "".join(self.one(k) for k in node.kids)

    def wrap(self, node: Node, mark: str) -> str:
        body = self.inline(node)
        inner = body.strip()
        if not inner:
            return body
        lead, tail = body[: len(body) - len(body.lstrip())], body[len(body.rstrip()) :]
        return f"{lead}{mark}{inner}{mark}{tail}"

    def block(self, text: str) -> str:
        text = text.strip("\n")
        return f"\n\n{text.strip(' ') if text.strip() else ''}\n\n" if text.strip() else "\n\n"

    def one(self, k) -> str:
        if isinstance(k, str):
            flat = re.sub(r"[ \t\r\n\f]+", " ", k)
            return re.sub(r"([*\\])", r"\\\1", flat)
        tag = k.tag
        if tag == "br":
            return "  \n"
        if tag == "hr":
            return "\n\n---\n\n"
        if tag in ("img", "input"):
            return ""
        if tag == "pre":
            return "\n\n```\n" + k.text().strip("\n") + "\n```\n\n"
        if tag in _CODE:
            body = k.text()
            return f"`{body}`" if body.strip() else body
        if tag in _STRONG:
            return self.wrap(k, "**")
        if tag in _EMPH:
            return self.wrap(k, "*")
        if tag in ("del", "s", "strike"):
            return self.wrap(k, "~~")
        if tag == "a":
            body = self.inline(k)
            href = link_target(k.attrs.get("href")) if "href" in k.attrs else None
            return body if href is None or not body.strip() else self.linked(body, href)
        if re.fullmatch("h[1-6]", tag):
            body = " ".join(self.inline(k).split())
            return f"\n\n{'#' * int(tag[1])} {body}\n\n" if body else ""
        if tag in ("ul", "ol"):
            return self.items(k)
        if tag == "blockquote":
            body = self.tidy(self.inline(k))
            return "\n\n" + "\n".join(f"> {x}".rstrip() for x in body.split("\n")) + "\n\n" if body else ""
        if tag == "table":
            return self.table(k) if is_data_table(k) else self.block(self.inline(k))
        if tag in _BLOCKS:
            return self.block(self.inline(k))
        return self.inline(k)

    def linked(self, body: str, href: str) -> str:
        inner = body.strip()
        lead, tail = body[: len(body) - len(body.lstrip())], body[len(body.rstrip()) :]
        return f"{lead}[{inner}]({href}){tail}"

    def items(self, node: Node) -> str:
        out, n = [], 0
        for k in node.kids:
            if not isinstance(k, Node) or k.tag != "li":
                stray = self.one(k).strip() if isinstance(k, Node) else k.strip()
                out += [stray] if stray else []
                continue
            n += 1
            mark = f"{n}. " if node.tag == "ol" else "* "
            body = re.sub(r"\n{2,}(?=( *)(\* |\d+\. ))", "\n", self.tidy(self.inline(k)))
            out.append(mark + body.replace("\n", "\n" + " " * len(mark)))
        nested = any(n.tag in ("ul", "ol") for n in self.above(node))
        return ("\n" if nested else "\n\n") + "\n".join(out) + ("\n" if nested else "\n\n")

    def above(self, node: Node):
        while node.up:
            node = node.up
            yield node

    def table(self, node: Node) -> str:
        rows = []
        for r in _rows(node):
            cells = [" ".join(self.inline(c).split()).replace("|", "\\|") for c in r.kids if isinstance(c, Node) and c.tag in ("td", "th")]
            if cells:
                rows.append(cells)
        if not rows:
            return ""
        width = max(map(len, rows))
        rows = [r + [""] * (width - len(r)) for r in rows]
        line = lambda r: "| " + " | ".join(r) + " |"
        return "\n\n" + "\n".join([line(rows[0]), line(["---"] * width), *map(line, rows[1:])]) + "\n\n"

    def tidy(self, text: str) -> str:
        """No blanks at line starts but those of code and lists, no more than one empty line."""
        out, fence = [], False
        for x in text.split("\n"):
            if x.startswith("```"):
                fence = not fence
            elif not fence and not re.match(r" +(\* |\d+\. |\S)", x):
                x = x if x.strip() else ""
            elif not fence:
                lead = len(x) - len(x.lstrip(" "))
                x = x if lead > 1 else x.lstrip(" ")
            out.append(x)
        return squeeze_lines("\n".join(out), "\n")


def html_to_md(html: str, most: int = 2_000_000) -> str:
    """Markdown of a page of at most `most` characters."""
    tree = _Tree()
    tree.feed(html[:most])
    tree.close()
    w = _Writer()
    return tidy_whitespace(w.tidy(w.inline(tree.root))).strip()


def tidy_whitespace(md: str) -> str:
    """Outside fences: no-break spaces become spaces, runs of spaces one, blank lines empty; hard breaks stay."""
    out, fence = [], False
    for x in md.split("\n"):
        if x.lstrip()[:3] == "```":
            fence = not fence
        elif not fence:
            x = x.replace(NBSP, " ")
            body = x.lstrip(" ")
            lead = x[: len(x) - len(body)]
            x = lead + re.sub("  +", " ", body).rstrip() + ("  " if body.endswith("  ") else "") if x.strip() else ""
        out.append(x)
    return "\n".join(out)


def squeeze_lines(text: str, ends: str | None = None) -> str:
    """At most one empty line in a row, none at the ends."""
    return re.sub("\n\n\n+", "\n\n", text).strip(ends)


_SAYS = re.compile(r"\s*(?:On\b.*|.*\b(?:wrote|schrieb)|.*\ba écrit)\s*:\s*", re.I)
_TAIL = re.compile(r"^\s*(?:--+\s*(?:Forwarded message|Original Message)\s*--+|From: .+\nSent: .+)", re.I | re.M)


def strip_quotes(body: str) -> str:
    """Take out quoted lines, the line or two that introduce them, and forwarded tails."""
    found = _TAIL.search(body)
    lines = (body[: found.start()] if found else body).split("\n")
    quoted = [x.lstrip()[:1] == ">" for x in lines]
    gone = quoted[:]
    for i, q in enumerate(quoted):
        if not q or (i and gone[i - 1]):
            continue
        j = i - 1
        while j >= 0 and not gone[j] and not lines[j].strip():
            j -= 1
        if j < 0:
            continue
        opens = [lines[k].lstrip().startswith("On ") for k in (j - 1, j)] if j else [False, True]
        if opens == [True, False] and _SAYS.fullmatch(f"{lines[j - 1]} {lines[j]}"):
            gone[j - 1] = gone[j] = True
        elif _SAYS.fullmatch(lines[j]):
            gone[j] = True
    return squeeze_lines("\n".join(x for x, g in zip(lines, gone) if not g))


_REPLY = re.compile(r"\s*(?:(?:aw|fwd|fw|re|wg)\s*:\s*)+", re.I)


def slugify(subject: str | None, most: int = 60) -> str:
    """Lower-case ASCII words joined by dashes, reply marks left out."""
    s = subject or ""
    lead = _REPLY.match(s)
    plain = unicodedata.normalize("NFKD", s[lead.end() :] if lead else s).encode("ascii", errors="ignore").lower().decode()
    return "-".join(re.findall("[a-z0-9]+", plain))[:most].strip("-") or "no-subject"
