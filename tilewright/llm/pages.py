"""Operator 9, main text of web pages: a host's repeated token runs, checked by the structure of the page.

A page is cut into blocks in page order.  A block lies in the main part (inside ``article`` or ``main``), in a part that is
boilerplate by its element, role or class (menus, headers, footers, sidebars, notices, adverts, forms, scripts,
reader comments), or in neither.  Every page goes through its host's search: the token streams of all pages of a host are put
together, and the suffix structure of :mod:`bundles` (suffix-array intervals over words, grouped by
prefix) finds runs of ``RUN`` or more tokens that distinct pages of the host share.  Covered tokens are
removed and the unique runs stay; a block of which less than half is covered quotes something and stays whole.
The structure then checks each block: what it knows as boilerplate goes, and a main part that the page marks stays whole.
Groups are keyed by host and prefix, so runs of different hosts never meet.

Pages of a host whose longest block (of the main part, or else open) outside links is the same carry copies of one article and are one page for the
search: their common text is no repeat of itself.  A page of which nothing would be left keeps that block.  Outside main parts a block of several
links and little else is a menu, and so are several blocks in a row that are one link each.  A class or id counts as a sign of
boilerplate if one of its parts says so and the others say nothing else ("cookie-banner", "notice--info", but not "share-prices");
some parts are signs whatever stands beside them ("user-comments-v2", "google-ads", "adbox", but not "has-sidebar").  An id on a heading or a
paragraph is none, as it names what that is about.  An element with the role of a main part is one.  An article inside a closed
boilerplate part, or with such a role or class, is no main part if the page has another one.

Repeated text inside a marked main part stays, as an article that appears on two pages is no boilerplate: the named method
alone would give wrong results there.

Pages are parsed once, and travel once, in compressed bundles (:mod:`bundles`).  Defined cases: null or empty html gives an empty
text; a null url is a host of its own; rows with a null page_id, or a page_id that occurs twice, are treated like other
pages; an empty table gives no rows; unclosed elements end where a main part begins or at the end; further columns are ignored.
"""

from __future__ import annotations

import html as html_
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bundles import with_runs
from .columns import intervals
from .common import steps, text_bytes, word_hashes, words
from .repeats import Rule, removed_symbols

RUN, K = 12, 6

# HTML elements by their role for the main text.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
RAW = ("script", "style", "textarea", "title", "xmp", "noembed", "noframes")
DROPPED = frozenset("head nav footer aside form script style noscript template svg math iframe object canvas select button textarea title dialog menu".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
HINTS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal newsletter subscribe subscription signup nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead comment comments commentlist disqus reply replies respond related recommended share sharing social pagination pager login".split())
# those that name nothing else, whatever stands beside them
SURE = frozenset("ad ads advert adverts advertisement advertisements sponsored newsletter navbar breadcrumb breadcrumbs sidebar masthead comment comments commentlist disqus pagination pager".split())
NEUTRAL = frozenset("list item items box bar block wrapper wrap container area section row column col widget inner outer top bottom left right main site page global slot unit thread text title label icon icons button buttons link links count body content card strip panel post entry article user reader form head foot header big small js the and by of us info warning error success primary secondary v".split())
# what says that a part is beside the named one, or about it
ABOUT = frozenset("has with without no not hide show toggle after before under over free hoc on in".split())
HEADERS = frozenset(("header", "site-header", "page-header", "global-header", "top-header"))

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)(?:>|\Z)", re.S)
#: A tag without regard to quotes, for pages whose quotes do not close.
PLAIN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?<![^\s=/\"'])([^\s=/\"']+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")
JOINED = re.compile(r"ads?(?:box|slot|unit|sense|wrap|wrapper|container|banner|block|space|zone)")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 p dt th".split())
OPEN, MAIN, BOILERPLATE = 0, 1, 2


def _names_boilerplate(token: str) -> bool:
    parts = [p.rstrip("0123456789") for p in re.split(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])", token)]
    parts = [p.lower() for p in parts if p]
    if not ABOUT.isdisjoint(parts):
        return False
    if not SURE.isdisjoint(parts) or any(JOINED.fullmatch(p) for p in parts):
        return True
    return not HINTS.isdisjoint(parts) and all(p in HINTS or p in NEUTRAL for p in parts)


def _attributes(text: str) -> list[tuple[str, str]]:
    return [(name.lower(), value.strip("\"'")) for name, value in ATTRIBUTE.findall(text)] if "=" in text else []


def _hinted(attributes: str, main: int = 1, name: str = "") -> bool:
    for key, value in _attributes(attributes):
        # an id on a heading or a paragraph names what it is about
        if (key == "class" or (key == "id" and name not in HEADINGS)) and any(_names_boilerplate(t) or (not main and t.lower() in HEADERS) for t in value.split()):
            return True
        if key == "role" and value.strip().lower() in ROLES:
            return True
    return False


def blocks(html: str) -> list[tuple[int, str]]:
    """(zone, text) of the blocks of a page in order; empty blocks are left out."""
    return [(zone, text) for zone, text, _ in linked_blocks(html)]


def linked_blocks(html: str) -> list[tuple[int, str, int]]:
    """Blocks with the characters of each that are in links.

    Articles inside a closed part that is boilerplate, or hinted at themselves, are main parts only of pages without others.
    """
    out, passed = _blocks(html, True)
    return _blocks(html, False)[0] if passed and not any(zone == MAIN for zone, *_ in out) else out


class Page:
    """The tags of a page in order, in one pass whatever the markup, and where elements are closed."""

    def __init__(self, html: str) -> None:
        self.html, self.last, self.failed = html, html.rfind(">"), 0
        self.pairs: dict[str, dict[int, int]] = {}

    def tag(self, at: int) -> re.Match | None:
        """The next tag or comment from a place on."""
        while (at := self.html.find("<", at)) >= 0:
            # a page with quotes that never close is read without them after some attempts, as each goes to its end
            found = (TAG if self.failed < 16 else PLAIN).match(self.html, at)
            if found is not None and (at <= self.last or found[2]):
                return found
            if at > self.last:
                return None if found is None and self.html.find("<", at + 1) < 0 else self._rest(at + 1)
            self.failed += found is None and self.html[at + 1 : at + 2].isalpha()
            at += 1
        return None

    def _rest(self, at: int) -> re.Match | None:
        """After the last end of a tag only one that is left open can follow."""
        return re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)\Z").search(self.html, at)

    def end(self, start: int, name: str) -> int:
        """Where the element of a name that starts at a place is closed, or -1; each name is paired once."""
        if name not in self.pairs:
            pairs, open_ = {}, []
            for found in re.compile(rf"<(/?){re.escape(name)}(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^'\">])*+>" if self.failed < 16 else rf"<(/?){re.escape(name)}(?=[\s/>])[^>]*>", re.I).finditer(self.html):
                if not found[1]:
                    if not found[0].endswith("/>"):
                        open_.append(found.start())
                elif open_:
                    pairs[open_.pop()] = found.end()
            self.pairs[name] = pairs
        return self.pairs[name].get(start, -1)


def _blocks(html: str, strict: bool) -> tuple[list[tuple[int, str, int]], bool]:
    """Blocks, and whether an article was passed over as it lies in a boilerplate part."""
    out: list[tuple[int, str, int]] = []
    held: list[str] = []
    main = 0  # depth of article and main elements
    dropped, depth = "", 0  # the element that is skipped, and how many of its name are open
    began, passed = 0, False  # where that element started
    link, linked, links, code = False, 0, 0, 0  # in a link, characters and links of the block, open pre and code elements
    page, at, until = Page(html), 0, -1  # where an element with the role of a main part ends

    def close() -> None:
        nonlocal linked, links
        text = " ".join(html_.unescape("".join(held)).split())
        held.clear()
        if text:
            # outside main parts several links and little else are a menu
            menu = not main and links > 1 and 10 * linked >= 8 * (len(text) - links)
            out.append((BOILERPLATE if dropped or menu else MAIN if main else OPEN, text, linked))
        linked = links = 0

    def text(part: str) -> None:
        nonlocal linked
        if part:
            held.append(part)
            linked += len(part) if link else 0

    while (found := page.tag(at)) is not None:
        text(html[at : found.start()])
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if found[1]:
            if name in BLOCK or name in DROPPED:
                close()
            link = link and name != "a"
            code -= code > 0 and name in ("pre", "code")
            if dropped:
                if name == dropped:
                    depth -= 1
                    if not depth:
                        dropped = ""
            elif at == until:
                main, until = 0, -1
            elif name in ("article", "main") and main:
                main -= 1
            continue
        alone = name in VOID or found[3].endswith("/")
        if name in ("br", "wbr", "hr", "img", "input"):
            held.append(" " if name == "br" else "")
        if name in BLOCK or name in DROPPED:
            close()
        named = name in BLOCK and not alone and ("role", "main") in [(k, v.strip().lower()) for k, v in _attributes(found[3])]
        begins = (name in ("article", "main") or named) and not main and dropped != "template"
        if begins and strict and dropped:
            closed = page.end(began, dropped) >= 0
            begins, passed = not closed, passed or closed
        links += name == "a"
        link = link or name == "a"
        code += name in ("pre", "code") and not alone
        if begins and strict and not alone and _hinted(found[3]):
            dropped, depth, began, passed = name, 1, found.start(), True
        elif begins:
            dropped, depth, main = "", 0, 1
            until = page.end(found.start(), name) if name not in ("article", "main") else -1
        elif dropped:
            depth += name == dropped and not alone
        elif not alone:
            if name in DROPPED or (name == "header" and not main) or (name in BLOCK and name not in ("html", "body", "article", "main") and _hinted(found[3], main, name)):
                dropped, depth, began = name, 1, found.start()
            elif name not in BLOCK and not code and _hinted(found[3], main, name) and (end := page.end(found.start(), name)) >= 0:
                at = end  # a hinted element inside a block
                link, code = link and name != "a", code - (name in ("pre", "code"))
            elif name in ("article", "main"):
                if main and _hinted(found[3]):
                    dropped, depth, began = name, 1, found.start()
                else:
                    main += 1
        if name in RAW and not alone:
            end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            at = end.start() if end else len(html)
    text(html[at:])
    close()
    # so are several blocks in a row that are one link each
    only = [zone == OPEN and linked >= len(t) for zone, t, linked in out]
    row = [only[i] and (only[i - 1 : i] == [True] or only[i + 1 : i + 2] == [True]) for i in range(len(out))]
    return [(BOILERPLATE if r else zone, t, linked) for r, (zone, t, linked) in zip(row, out, strict=True)], passed


def host_of(url: str = "url"):
    return F.coalesce(F.regexp_extract(F.lower(F.col(url)), r"^(?:[a-z][a-z0-9+.-]*:)?(?://)?([^/?#]*)", 1), F.lit(""))


def parsed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(page_id, url, blocks, main_block, main_line) of every page: its blocks a line each, behind the mark of what the structure says of them.

    ``main_block`` is the longest block of its article, ``main_line`` that block's line (null: none).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, longest, at = [], [], []
            for page in batch.column(2):
                found = linked_blocks(page.as_py() or "")
                marked = any(zone == MAIN for zone, *_ in found)
                marks = {MAIN: "* ", OPEN: "- " if marked else "+ ", BOILERPLATE: "- "}
                lines.append("\n".join(marks[zone] + t for zone, t, _ in found))
                article = [i for i, (zone, *_) in enumerate(found) if zone == (MAIN if marked else OPEN)]
                own = max((i for i in article if 2 * found[i][2] < len(found[i][1])), key=lambda i: len(found[i][1]), default=article[0]) if article else None
                longest.append(None if own is None else found[own][1])
                at.append(own)
            arrays = [*batch.columns[:2], *(pa.array(x, pa.string()) for x in (lines, longest)), pa.array(at, pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "blocks", "main_block", "main_line"])

    picked = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return picked.mapInArrow(run, "page_id bigint, url string, blocks string, main_block string, main_line int")


def word_contexts(content: pa.Array, left: np.ndarray, group: np.ndarray, depth: int, k: int = K) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Suffix-array intervals of the words before (backwards) and after the anchors, by depth."""
    data, offsets = text_bytes(content)
    starts, ends, rows = words(data, offsets)
    _, values = np.unique(word_hashes(data, starts, ends), return_inverse=True)
    count = np.bincount(rows, minlength=len(content))
    at = np.cumsum(count) - count
    anchor, many, none = at + left, len(values), len(values)
    d = np.arange(depth)[None, :]
    padded = np.append(values, many)
    before = padded[np.where(d < left[:, None], anchor[:, None] - 1 - d, none)]
    after = padded[np.where(d < (at + count - anchor - k)[:, None], anchor[:, None] + k + d, none)]
    return intervals(before, group, many), intervals(after, group, many)


RULE = Rule("words", RUN, K, "shared", word_contexts)


def kept_blocks(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> list[str]:
    """The text of each page of a batch: its open blocks without runs that other pages of the host share.

    A page of which nothing would be left has its longest open block outside links, which then is its article, quoted elsewhere.
    """
    starts, ends, rows = words(data, offsets)
    count = np.bincount(rows, minlength=len(part)) if len(rows) else np.zeros(len(part), np.int64)
    at = np.concatenate(([0], np.cumsum(count)))
    gone = removed_symbols(part, at, RUN)
    line = np.cumsum(data == 10)[starts] if len(starts) else starts
    first = np.ones(len(line), bool)
    first[1:] = (line[1:] != line[:-1]) | (rows[1:] != rows[:-1])
    begin = np.flatnonzero(first)
    size = np.diff(np.append(begin, len(line))) - 1
    covered = np.add.reduceat(gone & ~first, begin) if len(begin) else begin
    whole = 2 * covered < size  # the block quotes something
    raw, texts = data.tobytes(), [[] for _ in range(len(part))]
    for b, n, all_ in zip(begin.tolist(), size.tolist(), whole.tolist(), strict=True):
        mark = raw[starts[b] : ends[b]]
        if mark == b"-":  # the mark of a block that is boilerplate
            continue
        sure = mark == b"*"  # the check that follows the search: a main part that the page marks is no boilerplate, whoever repeats it
        kept = [raw[starts[w] : ends[w]].decode() for w in range(b + 1, b + 1 + n) if all_ or sure or not gone[w]]
        if kept:
            texts[rows[b]].append(" ".join(kept))
    own = part.column(part.schema.get_field_index("main_line")).to_pylist()
    edge = offsets.tolist()
    # a line is a block behind its mark and a space
    return ["\n\n".join(t) if t else "" if o is None else raw[edge[i] : edge[i + 1]].split(b"\n")[o][2:].decode() for i, (t, o) in enumerate(zip(texts, own, strict=True))]


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    found = parsed(pages, id_col, url_col, html_col)
    host = F.xxhash64(host_of("url"))
    row = F.xxhash64("page_id", "url", "blocks")
    # rows of one article copy share a class, whose texts are no repeats of each other
    class_ = F.coalesce(F.xxhash64(host, "main_block"), row)
    judged = with_runs(found.select(row.alias("row"), class_.alias("v"), host.alias("salt"), F.col("blocks").alias("text"), "page_id", "url", "main_line"), RULE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in steps(batches):
            columns = [part.column(part.schema.get_field_index(n)) for n in ("page_id", "url")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kept_blocks(part, data, offsets), pa.string())], ["page_id", "url", "text"])

    return judged.mapInArrow(run, "page_id bigint, url string, text string").withColumn("n_chars", F.length("text").cast("bigint"))
