"""Main text of HTML pages by line-block distribution.

Markup is stripped to lines: a block (paragraph, heading, list item, cell) is one line,
an edge of a container leaves a blank one, and an element that is no article text
(script, menu, footer, form, advert, notice, comments ...: by tag, role, class or id)
leaves as many blank lines as a window is long. A line weighs the length of its text
without links. Sums over windows of ``WINDOW`` lines make the distribution. It dives
where a window sums to zero; a stretch between two dives is text if a window in it
surges above ``SURGE``, and then all its lines are kept, short ones and links included.

Where a page marks its article (``article`` or ``main`` with text in it), its lines weigh ``SURGE``
more, so that short paragraphs surge too, and lines outside weigh nothing. If no window
surges, the stretch of largest weight is kept. If class and id
names leave no text at all, the page is read again without them.

Character references are decoded once, after the markup has gone; white space inside a
block becomes one space; blocks are joined by one space in page order. Unclosed and
stray tags are met as a browser would: an end tag closes what is open inside.

Null and empty html give the empty text, null ids and urls stay null. Pages are read
one by one, whole, so repeated rows give repeated results and ties cannot occur; an empty
table gives no rows. Other columns are not looked at. Work is linear in a page's length.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, SURGE = 3, 86

_RAW = {"script", "style", "title", "textarea", "iframe", "noframes", "noembed", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_DROPPED = {
    "head", "nav", "footer", "aside", "form", "button", "select", "noscript", "template", "svg", "object", "audio", "video",
    "canvas", "dialog", "menu", "datalist", "map",
}
_LINES = {
    "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "tr", "pre", "blockquote", "caption", "figcaption",
    "summary", "address", "hr", "legend", "option", "center",
}
_CONTAINERS = {
    "html", "body", "div", "section", "article", "main", "header", "ul", "ol", "dl", "table", "thead", "tbody", "tfoot",
    "figure", "details", "fieldset", "hgroup",
}
_ARTICLE = {"article", "main"}
_KEPT = {"html", "body", *_ARTICLE}
#: What closes by itself when the next of its kind opens.
_SIBLINGS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"},
}
_ROLES = {
    "navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar",
    "toolbar", "tablist", "status",
}
#: Parts of class and id names; HEAD names are no hint inside an article.
_HEAD = {"header", "masthead", "topbar"}
_HINTS = _HEAD | {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "banners", "breadcrumb",
    "breadcrumbs", "comment", "comments", "commentlist", "consent", "cookie", "cookies", "copyright", "disqus", "discussion",
    "footer", "gdpr", "login", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification",
    "pager", "pagination", "popup", "promo", "promotion", "recommended", "related", "reply", "replies", "respond", "responses",
    "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "widget",
}

_NAME = re.compile(r"/?([A-Za-z][^\s/<>]*)")
_TAG_END = re.compile(r"""(?:[^<>"']++|"[^"]*+"|'[^']*+')*+>""")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'<>]++)))?+""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_HIDDEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)}


def _unwanted(name: str, raw: str, in_article: bool, hints: bool) -> bool:
    """Whether an element is no article text."""
    if name in _KEPT:
        return False
    if name in _DROPPED or (name == "header" and not in_article):
        return True
    if not raw or raw.isspace():
        return False
    told = _attributes(raw)
    if told.get("role", "").lower() in _ROLES or "hidden" in told or told.get("aria-hidden") == "true":
        return True
    if _HIDDEN.search(told.get("style", "")):
        return True
    if not hints:
        return False
    names = {w.lower() for w in _WORD.findall(f"{told.get('class', '')} {told.get('id', '')}")}
    return bool(names & (_HINTS - _HEAD if in_article else _HINTS))


class Lines:
    """The lines of one page: text, its length without links, and whether an article holds it."""

    def __init__(self, hints: bool):
        self.hints = hints
        self.text: list[str] = []
        self.weight: list[int] = []
        self.inside: list[bool] = []
        self._part: list[str] = []
        self._linked = 0
        self._open: list[str] = []
        self._count: dict[str, int] = {}
        self._dropped = self._links = self._articles = 0
        self._marks: list[bool] = []

    def _flush(self, blanks: int = 0) -> None:
        if self._part:
            text = " ".join(unescape("".join(self._part)).split())
            if text:
                self.text.append(text)
                self.weight.append(max(0, len(text) - self._linked))
                self.inside.append(self._articles > 0)
            self._part, self._linked = [], 0
        for _ in range(blanks):
            self.text.append("")
            self.weight.append(0)
            self.inside.append(self._articles > 0)

    def words(self, raw: str) -> None:
        if raw and not self._dropped:
            self._part.append(raw)
            if self._links:
                self._linked += len(" ".join(unescape(raw).split()))

    def _pop(self) -> None:
        name, dropped = self._open.pop(), self._marks.pop()
        self._count[name] -= 1
        if name in _LINES or name in _CONTAINERS or dropped:
            self._flush(name in _CONTAINERS and not self._dropped)
        if dropped:
            self._dropped -= 1
            if not self._dropped:
                self._flush(WINDOW)
        self._links -= name == "a"
        self._articles -= name in _ARTICLE

    def begin(self, name: str, raw: str) -> None:
        block = name in _LINES or name in _CONTAINERS or name in _DROPPED
        if block and self._open and self._open[-1] == "p":
            self._pop()
        closes = _SIBLINGS.get(name)
        while closes and self._open and self._open[-1] in closes and not (name in ("td", "th") and self._open[-1] == "tr"):
            self._pop()
        if name in _VOID or raw.endswith("/"):
            if name == "br":
                self.words("\n")
            elif block:
                self._flush()
            return
        dropped = self._dropped == 0 and _unwanted(name, raw, self._articles > 0, self.hints)
        if not self._dropped and (block or dropped):
            self._flush(WINDOW if dropped else name in _CONTAINERS)
        self._open.append(name)
        self._marks.append(dropped)
        self._count[name] = self._count.get(name, 0) + 1
        self._dropped += dropped
        self._links += name == "a"
        self._articles += name in _ARTICLE

    def end(self, name: str) -> None:
        if self._count.get(name):
            while self._open[-1] != name:
                self._pop()
            self._pop()
        elif name == "p" or name == "br":
            self._flush()

    def done(self) -> None:
        self._flush(WINDOW)


def read_lines(html: str, hints: bool = True) -> Lines:
    lines, at = Lines(hints), 0
    while at < len(html):
        start = html.find("<", at)
        if start < 0:
            lines.words(html[at:])
            break
        lines.words(html[at:start])
        mark = html[start + 1 : start + 2]
        if mark in ("!", "?"):
            comment = html.startswith("<!--", start)
            stop = html.find("-->" if comment else ">", start + (4 if comment else 2))
            at = len(html) if stop < 0 else stop + (3 if comment else 1)
            continue
        name = _NAME.match(html, start + 1)
        stop = name and _TAG_END.match(html, name.end())
        if not stop:
            lines.words("&lt;")
            at = start + 1
            continue
        tag, at = name[1].lower(), stop.end()
        if mark == "/":
            lines.end(tag)
        elif tag in _RAW:
            closing = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            at = len(html) if closing is None else closing.start()
            if closing is not None:
                last = html.find(">", at)
                at = len(html) if last < 0 else last + 1
        else:
            lines.begin(tag, html[name.end() : at - 1])
    lines.done()
    return lines


def weights(lines: Lines) -> list[int]:
    """Line weights, with the page's own mark of its article."""
    if not any(w and i for w, i in zip(lines.weight, lines.inside, strict=True)):
        return lines.weight
    return [w + SURGE if i and w else 0 for w, i in zip(lines.weight, lines.inside, strict=True)]


def stretches(weight: list[int]) -> list[tuple[int, int, int]]:
    """(first line, end line, largest window sum) between dives to zero."""
    found, start, most, total = [], None, 0, sum(weight[:WINDOW])
    for i in range(len(weight)):
        if total and start is None:
            start, most = i, 0
        if total:
            most = max(most, total)
        elif start is not None:
            found.append((start, i, most))
            start = None
        total += (weight[i + WINDOW] if i + WINDOW < len(weight) else 0) - weight[i]
    if start is not None:
        found.append((start, len(weight), most))
    return found


def main_text(html: str | None) -> str:
    """The main text of one page."""
    for hints in (True, False):
        lines = read_lines(html or "", hints)
        weight = weights(lines)
        found = stretches(weight)
        kept = [f for f in found if f[2] > SURGE] or sorted(found, key=lambda f: (-sum(weight[f[0] : f[1]]), f[0]))[:1]
        if kept:
            inside = weight is not lines.weight
            return " ".join(
                t for a, b, _ in kept for t, i in zip(lines.text[a:b], lines.inside[a:b], strict=True) if t and (i or not inside)
            )
    return ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches):
        for batch in batches:
            ids, urls, rows = batch.column("page_id"), batch.column("url"), batch.column("html")
            lo, texts, held = 0, [], 0
            for k in range(batch.num_rows):
                texts.append(main_text(rows[k].as_py()))
                held += len(texts[-1])
                if held > 1 << 20 or k == batch.num_rows - 1:
                    part = [ids.slice(lo, len(texts)), urls.slice(lo, len(texts)), pa.array(texts), pa.array([len(t) for t in texts], pa.int64())]
                    yield pa.RecordBatch.from_arrays(part, names=["page_id", "url", "text", "n_chars"])
                    lo, texts, held = k + 1, [], 0

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
