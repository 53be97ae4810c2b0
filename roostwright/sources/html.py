"""Anchor scan: candidate cards out of stored HTML pages."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset(("script", "style", "template"))
BLOCK = frozenset("address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header li main nav ol p pre section table tr ul".split())


@dataclass(frozen=True)
class Profile:
    """How one source's cards are found: text the link must (not) hold, how far to climb for a price, and what to keep."""

    source: str
    contains: tuple[str, ...] = ()
    excludes: tuple[str, ...] = ()
    matches: str | None = None
    climb: int = 8
    cap: int = 500
    strip: bool = True
    own_text_first: bool = False

    def wants(self, href: str) -> bool:
        return all(c in href for c in self.contains) and not any(c in href for c in self.excludes) and (self.matches is None or re.search(self.matches, href) is not None)


# The sources' link forms, climbs and text caps.
PROFILES = {
    "Barnes": Profile("Barnes", ("/ref-", "/france/paris"), climb=6, cap=400, strip=False),
    "SeLoger rent": Profile("SeLoger", ("/annonces/locations/",)),
    "SeLoger sale": Profile("SeLoger", ("/annonces/achat/",)),
    "Junot": Profile("Junot", ("/fr/biens/",), ("pinterest.com",)),
    "ParisRental furnished": Profile("ParisRental", ("/furnished-apartments/",), matches=re.escape("/furnished-apartments/") + r".+-\d+/?$"),
    "ParisRental unfurnished": Profile("ParisRental", ("/empty-apartments/",), matches=re.escape("/empty-apartments/") + r".+-\d+/?$"),
    "ParisRental sale": Profile("ParisRental", ("/apartments-for-sale/",), matches=re.escape("/apartments-for-sale/") + r".+-\d+/?$"),
    "DanielFeau": Profile("DanielFeau", ("/annonce-immobiliere/",)),
    "Book-a-Flat": Profile("Book-a-Flat", ("/apartment-paris-",), climb=6, own_text_first=True),
    "Perenium": Profile("Perenium", ("/fiche-",)),
    "Eiffel Housing": Profile("Eiffel Housing", ("/en/properties/",)),
}


def suburb_profile(slug: str) -> Profile:
    return Profile("Barnes", ("/ref-", f"/france/{slug}"), climb=6, cap=400, strip=False)


class _Page(HTMLParser):
    """The elements of a page as (parent, start and end of their text), and its links in order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text, self.size = [], 0
        self.parent, self.span, self.open = [-1], [[0, 0]], [(0, "")]
        self.links: list[tuple[int, str]] = []
        self.silent, self.depth = 0, Counter()  # of tags that are open

    def _add(self, s: str) -> None:
        self.text.append(s)
        self.size += len(s)

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK and self.size:
            self._add("\n")
        self.parent.append(self.open[-1][0])
        self.span.append([self.size, self.size])
        me = len(self.parent) - 1
        href = dict(attrs).get("href")
        if tag == "a" and href is not None:
            self.links.append((me, href))
        if tag not in VOID:
            self.open.append((me, tag))
            self.depth[tag] += 1
            self.silent += tag in SILENT

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not self.depth[tag]:
            return
        while len(self.open) > 1:
            me, t = self.open.pop()
            self.span[me][1] = self.size
            self.depth[t] -= 1
            self.silent -= t in SILENT
            if t == tag:
                break
        if tag in BLOCK:
            self._add("\n")

    def handle_data(self, data):
        if not self.silent and data:
            self._add(data)

    def done(self) -> str:
        self.close()
        while self.open:
            self.span[self.open.pop()[0]][1] = self.size
        return "".join(self.text)


def anchors(html: str | None) -> list[str]:
    """The hrefs of a page's links, in order."""
    page = _Page()
    page.feed(html or "")
    return [h for _, h in page.links]


def visible(whole: str, start: int, end: int, most: int) -> str:
    """The lines of a stretch of text, trimmed, without blank ones; no further than `most` characters need."""
    out, size = [], 0
    while start < end and size <= most:
        stop = whole.find("\n", start, end)
        stop = end if stop < 0 else stop
        if line := whole[start:stop].strip(" \t\r"):
            out.append(line)
            size += len(line) + 1
        start = stop + 1
    return "\n".join(out)[:most]


def cards(html: str | None, profile: Profile) -> list[tuple[str, str]]:
    """(url, rawText) of a page's cards: each wanted href once, with the text of the nearest ancestor that names a price."""
    page = _Page()
    page.feed(html or "")
    whole, out, seen = page.done(), [], set()
    signs = [i for i, c in enumerate(whole) if c == "€"] if "€" in whole else []
    for me, href in page.links if signs else ():
        if not profile.wants(href) or href in seen:
            continue
        seen.add(href)
        at = me
        for step in range(profile.climb):
            if not (profile.own_text_first and step == 0):
                at = page.parent[at]
            if at < 0:
                break
            start, end = page.span[at]
            i = bisect_left(signs, start)
            if i < len(signs) and signs[i] < end:
                out.append((href.split("?")[0] if profile.strip else href, visible(whole, start, end, profile.cap)))
                break
    return out


#: Bytes of pages that a worker has as strings at a time.
AT_ONCE = 1 << 20


def slices(batches: Iterator[pa.RecordBatch], html_col: str, most: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, in slices of at most `most` bytes of pages; a longer page comes alone. Once all is read, unused memory goes back to the system: the worker may stand idle for long."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(html_col)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
            yield b.slice(lo, hi - lo)
            lo = hi
        b = None  # else it stays while the next one is read
    pa.default_memory_pool().release_unused()


def _scan(pages: DataFrame, columns: list[str], find: Callable, names: tuple[str, ...]) -> DataFrame:
    """A row for each tuple that `find` gives of a page: the id, pos (from 0), and the strings `names`. columns are the id's, the page's, and what else find takes.

    Whole batches (10,000 rows or 64 MB) stay in Arrow; a slice at a time becomes Python strings.
    """
    schema = pa.schema([(columns[0], pa.int64()), ("pos", pa.int32()), *[(n, pa.string()) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, columns[1]):
            rows = [(i, p, *got) for i, *page in zip(*[b.column(c).to_pylist() for c in columns], strict=True) for p, got in enumerate(find(*page))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(schema.types)], schema=schema)

    return pages.select(*columns).mapInArrow(run, ", ".join([f"`{columns[0]}` long", "pos int", *[f"{n} string" for n in names]]))


def scan_anchors(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """A row for each link: id_col, pos (from 0), href."""
    return _scan(pages, [id_col, html_col], lambda html: [(h,) for h in anchors(html)], ("href",))


def scan_cards(pages: DataFrame, profile: Profile | dict[str, Profile], id_col: str = "page_id", html_col: str = "html", by: str = "profile") -> DataFrame:
    """A row for each card: id_col, pos (from 0), url, rawText. With several profiles, each page is read by the one that its column `by` names; a name without one is an error."""
    if isinstance(profile, Profile):
        return _scan(pages, [id_col, html_col], lambda html: cards(html, profile), ("url", "rawText"))
    return _scan(pages, [id_col, html_col, by], lambda html, name: cards(html, profile[name]), ("url", "rawText"))
