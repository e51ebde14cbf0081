"""Main text of HTML pages by line-block distribution.

Markup is stripped to one line of text per block. What is never article text (menus, forms,
adverts, comments and so on, told by element or by the names in class, id and role) leaves an empty
line. The lines of the article element are looked at, or all lines on a page without one. Text
lengths are summed over sliding windows of lines, not counting lines that are mostly links. A
window sum that surges over a threshold opens a run of text, a window without text (a dive) ends
it. Everything between a surge and its dive is kept, short lines and single links too; lines in no
run, such as lists of links behind the text, are not.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of

#: Lines of a window; a surge is a window sum of at least SURGE, or of this share of the largest one.
WINDOW, SURGE, SHARE = 3, 80, 0.25
#: Share of a line's text that may stand in links before the line counts as a menu.
LINKED = 0.6
#: Lines shorter than this that are no paragraph don't begin or end a run on a page without article.
SHORT = 40

# Elements of HTML.
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "canvas", "audio", "video", "select", "title", "head")
NOISE = ("nav", "footer", "aside", "form", "button", "dialog", "menu", "header", "fieldset", "label", "input")
BLOCKS = ("address article blockquote body br caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol option p pre section summary table tbody td tfoot th thead tr ul " + " ".join(NOISE)).split()
PARAGRAPHS = "p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption".split()
# Names in class, id and role of what is not article text, and of what holds the article.
NAMES = (
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login sidebar side rail menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead toolbar share sharing social follow related recommended recommendations trending popular comment comments commentlist comment-list disqus disqus_thread reply replies respond responses pagination pager widget widgets skip print-only hidden navigation complementary contentinfo search site-header site-footer page-header page-footer"
).split()
PREFIXES = "ad- ads- ad_ advert banner- breadcrumb comment- comments- comment_ comments_ cookie- cookies- disqus footer- menu- nav- navbar- newsletter- pagination- popup- promo- recommended- related- share- sharing- sidebar- social- sponsor subscribe- widget-".split()
CONTENT = "article article-body article-content article-text articlebody body-content content content-body entry entry-content main main-content maincontent page-content post post-body post-content post-text postcontent story story-body story-content text text-content".split()

#: A tag without "<" inside, and the name of any other tag; none of them looks past the next "<" or name.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)((?:[^\"'<>]|\"[^\"<]*+\"|'[^'<]*+')*+)>")
OPENED = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
SPECIAL = re.compile(r"[\"'>]")
#: Decimal references with more digits than a code point can have.
LONG_REFERENCE = re.compile(r"&#([0-9]{8,});?")
NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none|visibility\s*:\s*hidden", re.I)
BODY = re.compile(r"(?=<body)", re.I)
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
_raw, _noise, _blocks, _paragraphs, _names, _content, _prefixes = set(RAW), set(NOISE), set(BLOCKS), set(PARAGRAPHS), set(NAMES), set(CONTENT), tuple(PREFIXES)
_close = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}


def names_of(attrs: str) -> list[str]:
    return [w for _, *values in NAMED.findall(attrs) for v in values for w in v.lower().split()] if attrs else []


def is_noise(tag: str, attrs: str, in_article: bool) -> bool:
    """Whether an element is no article text. Whole names count, or known beginnings of names; an element that
    also has a name of what holds the article is one that is styled by the others."""
    if tag in _noise:
        return not (tag == "header" and in_article)
    if not attrs or tag in ("body", "html", "main"):
        return False
    if HIDDEN.search(attrs):
        return True
    names = names_of(attrs)
    return not any(w in _content for w in names) and any(w in _names or w.startswith(_prefixes) for w in names)


class Tags:
    """Finds the tags of a page one after another, in time linear in its length whatever is left open."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.marks: list[int] | None = None  # places of quotes and of ">"
        self.ends: dict[int, int] = {}  # mark outside quotes -> end of the tag it stands in, or -1

    def end_of(self, at: int) -> int:
        """Place of the first ">" outside quotes from at on, -1 if none."""
        if self.marks is None:
            self.marks = [m.start() for m in SPECIAL.finditer(self.page)]
        passed, k, end = [], bisect_left(self.marks, at), -1
        while k < len(self.marks):
            mark = self.marks[k]
            if mark in self.ends:
                end = self.ends[mark]
                break
            passed.append(mark)
            if self.page[mark] == ">":
                end = mark
                break
            closing = self.page.find(self.page[mark], mark + 1)
            if closing < 0:
                break
            k = bisect_left(self.marks, closing + 1)
        self.ends.update(dict.fromkeys(passed, end))
        return end

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """(start, stop, tag, closing, attributes) of the next tag; comments and declarations have no name."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            if page.startswith("<!--", start):
                stop = page.find("-->", start + 4)
                return start, len(page) if stop < 0 else stop + 3, "", False, ""
            if start > self.last:
                at = page.find("<!--", start)
                if at < 0:
                    return None
                continue
            if m := TAG.match(page, start):
                return start, m.end(), m[2].lower(), bool(m[1]), m[3]
            if (m := OPENED.match(page, start)) and (end := self.end_of(m.end())) >= 0:
                return start, end + 1, m[2].lower(), bool(m[1]), page[m.end() : end]
            if page[start + 1 : start + 2] in ("!", "?", "/"):
                return start, page.find(">", start) + 1, "", False, ""
            at = start + 1
        return None


def elements(page: str) -> list[tuple[int, int, str, bool, str, int]]:
    """(start, stop, tag, closing, attributes, place of the tag that closes it or -1) of the tags of a
    page. Comments and elements whose content is no text are one piece with an empty name."""
    found, open_, at, tags = [], {}, 0, Tags(page)
    unclosed: set[str] = set()  # elements that nothing further on closes
    while m := tags.next(at):
        start, at, tag, closing, attrs = m
        if tag in _raw and not closing:
            done = None
            if not attrs.endswith("/") and tag not in unclosed:
                done = _close[tag].search(page, at)
                if tag == "head":  # ends at the body where it isn't closed
                    done = done or BODY.search(page, at)
                if not done:
                    unclosed.add(tag)
            at = done.end() if done else len(page) if tag in ("script", "style", "template", "textarea", "noscript") else at
            tag = ""
        elif closing and open_.get(tag):
            k = open_[tag].pop()
            found[k] = (*found[k][:5], len(found))
        elif tag and not closing and tag not in VOID and not attrs.endswith("/"):
            open_.setdefault(tag, []).append(len(found))
        found.append((start, at, tag, closing, attrs, -1))
    return found


def decoded(text: str) -> str:
    """Character references decoded; what is beyond the last code point is U+FFFD however many digits it has."""
    if "&" not in text:
        return text
    short = LONG_REFERENCE.sub(lambda m: f"&#{d};" if len(d := m[1].lstrip("0") or "0") < 8 else "\ufffd", text)
    return entities.unescape(short)


class Line:
    __slots__ = ("text", "article", "linked", "paragraph")

    def __init__(self, text: str = "", article: bool = False, linked: int = 0, paragraph: bool = False):
        self.text, self.article, self.linked, self.paragraph = text, article, linked, paragraph


def lines_of(page: str) -> list[Line]:
    """The lines of a page; noise is an empty line, and the borders of the article a window of them."""
    tags = elements(page)
    frame = ("article", "main") if any(t[2] in ("article", "main") and not t[3] and not is_noise(t[2], t[4], False) for t in tags) else ()
    ahead = [-1] * (len(tags) + 1)  # the next tag that opens an article
    for j in range(len(tags) - 1, -1, -1):
        ahead[j] = j if tags[j][2] in frame and not tags[j][3] else ahead[j + 1]
    lines: list[Line] = []
    piece: list[str] = []
    depth = linked = in_link = at = k = 0
    inside: list[int] = []  # where the article's elements end, by place
    block = ""

    def flush() -> None:
        nonlocal linked
        text = " ".join(decoded("".join(piece)).split())
        piece.clear()
        if text:
            lines.append(Line(text, depth > 0, linked, block in _paragraphs))
        linked = 0

    def border() -> None:
        flush()
        lines.extend(Line() for _ in range(WINDOW))

    while k <= len(tags):
        start, stop, tag, closing, attrs, end = tags[k] if k < len(tags) else (len(page), len(page), "", False, "", -1)
        if start > at:
            piece.append(page[at:start])
            linked += in_link and len(page[at:start].strip())
        at, k = stop, k + 1
        if not tag:
            continue
        if not closing and tag not in VOID and is_noise(tag, attrs, depth > 0):
            until = end if end >= 0 else ahead[k] - 1
            if until >= k - 1:  # never closed and no article behind it: its own text can't be told
                flush()
                lines.append(Line("", depth > 0))
                at, k = tags[until][1], until + 1
                continue
        holds = tag in frame or (not frame and tag in ("div", "section", "td") and not closing and any(w in _content for w in names_of(attrs)))
        if holds and not closing:
            border()
            depth += 1
            inside.append(end)
        elif closing and inside and inside[-1] == k - 1:
            border()
            inside.pop()
            depth -= 1
        elif tag == "a":
            in_link = 0 if closing else 1
        if tag in _blocks:
            flush()
            block = "" if closing else tag if tag != "br" else block
    flush()
    return lines


def runs(lines: list[Line], trim: bool) -> list[tuple[int, int]]:
    """First and last line (exclusive) of each run of text between a surge and its dive."""
    size = [len(x.text) if x.linked < LINKED * len(x.text) else 0 for x in lines]
    sums = [sum(size[k : k + WINDOW]) for k in range(len(size))]
    least = min(SURGE, SHARE * max(sums, default=0))
    out, k = [], 0
    while k < len(size):
        if not size[k]:
            k += 1
            continue
        begin, surge = k, False
        while k < len(size) and sums[k] > 0:  # sums of nothing: the dive
            surge, k = surge or sums[k] >= least, k + 1
        end = k
        while trim and begin < end and len(lines[begin].text) < SHORT and not lines[begin].paragraph:
            begin += 1
        while end > begin and (not size[end - 1] or (trim and len(lines[end - 1].text) < SHORT and not lines[end - 1].paragraph)):
            end -= 1
        if surge and begin < end:
            out.append((begin, end))
    return out


def main_text(page: str) -> str:
    lines = lines_of(page)
    whole = any(x.article and x.text for x in lines)
    if whole:  # lines outside the article are gaps
        lines = [x if x.article or not x.text else Line() for x in lines]
    return " ".join(x.text for a, b in runs(lines, not whole) for x in lines[a:b] if x.text)


def _extract(batches):
    schema = {"page_id": pa.int64(), "url": pa.string(), "text": pa.string(), "n_chars": pa.int64()}
    for batch in batches:
        texts = [main_text(h) if h else "" for h in batch.column("html").to_pylist()]
        yield batch_of(schema, page_id=batch.column("page_id"), url=batch.column("url"), text=texts, n_chars=[len(t) for t in texts])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page, from its whole html.

    Null or empty html, and pages without article text, give an empty text. Ids and urls may be
    null or repeated; other columns are not read. An empty table gives an empty result. Very long
    pages take time linear in their length, tags and quotes that are never closed included.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
