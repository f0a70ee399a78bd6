"""Main text of web pages: markup decides what it names, a host's suffix array decides the rest.

A page becomes blocks of text in page order. Blocks inside `article` or `main` are the main text; blocks inside elements
that are named as something else (`nav`, `footer`, `aside`, `form`, a class or id such as `ad` or `comments`) are not.
Blocks that are neither are judged by repetition: the token streams of all blocks outside of articles are concatenated by host,
their suffixes are sorted into the classes of their first `depth` tokens, and a class that occurs on distinct pages of
the host is a repeated substring. A block that repeated substrings cover whole is boilerplate; all others stay, with all their words.

A class is reduced to its smallest and largest page before it moves, so a host with most pages is no hot group.
Pages without blocks to judge need no join.

Null html is an empty page, whose text is empty. A null url is a host of its own kind (the empty one). Repeated rows are one
page for the count of distinct pages and each get their row. Other columns are not carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pulsegrid.llm.common import Scratch, row_key, text_bytes

DEPTH = 6
MAIN, OTHER, OPEN = 0, 1, 2
# Names of elements.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
DROPPED = frozenset(
    "head script style noscript template nav footer header aside form menu button select textarea input svg iframe object "
    "canvas audio video dialog title".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# A p element ends where one of these begins.
ENDS_P = BLOCKS - {"body", "html", "li", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "dd", "dt", "option"}
WORDS_OF_OTHER = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsored promo promotion menu nav navbar navigation breadcrumb "
    "breadcrumbs sidebar footer masthead cookie cookies consent notice notices alert popup modal newsletter subscribe "
    "signup login share sharing social related recommended comment comments discussion disqus replies widget pagination".split()
)
_PARTS = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"\s+")


class _Blocks(HTMLParser):
    """(kind, text) of the blocks of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[int, str]] = []
        self.stack: list[tuple[str, tuple[int, str]]] = []
        self.text: list[str] = []
        self.kind, self.turned = OPEN, ""

    def _flush(self) -> None:
        if self.text:
            text = _SPACE.sub(" ", "".join(self.text)).strip()
            if text:
                self.blocks.append((self.kind, text))
            self.text = []

    def _kind_of(self, tag: str, attrs: list) -> int | None:
        for name, value in attrs:
            if name in ("class", "id", "role") and value and tag not in ("body", "html"):
                if not WORDS_OF_OTHER.isdisjoint(_PARTS.split(value.lower())):
                    return OTHER
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return OTHER
        if tag in DROPPED:
            # The title block of an article is part of it.
            return None if tag == "header" and self.kind == MAIN else OTHER
        return MAIN if tag in ("article", "main") else None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self._flush()
            if tag in ENDS_P and any(t == "p" for t, _ in self.stack):
                self._close("p")
        elif tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        kind, before = self._kind_of(tag, attrs), (self.kind, self.turned)
        if kind == OTHER and self.kind != OTHER:
            self.kind, self.turned = OTHER, tag
        elif kind == MAIN and (self.kind != OTHER or self.turned in ("nav", "header")):
            # An article in a menu means a menu that was never closed; in comments or an aside it is none.
            self.kind = MAIN
        self.stack.append((tag, before))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.text.append(" ")
        elif tag in BLOCKS:
            self._flush()

    def _close(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self.kind, self.turned = self.stack[i][1]
                del self.stack[i:]
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._flush()
        self._close(tag)

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1][0] in ("script", "style"):
            return
        if self.kind == OTHER and self.stack and any(t in ("head", "title") for t, _ in self.stack):
            return
        self.text.append(data)


def page_blocks(html: str) -> list[tuple[int, str]]:
    parser = _Blocks()
    try:
        parser.feed(html)
        parser.close()
    except AssertionError:  # markup the parser gives up on; what came before counts
        pass
    parser._flush()
    return parser.blocks


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for page_id, url, html in zip(*(batch.column(i).to_pylist() for i in range(3))):
            blocks = page_blocks(html or "")
            key = row_key(page_id, text_bytes(url) + b"\0" + text_bytes(html))
            main = "\n".join(text for kind, text in blocks if kind == MAIN)
            judged = any(kind == OPEN for kind, _ in blocks)
            outside = [text for kind, text in blocks if kind != MAIN]
            # Blocks in page order are needed only where some are judged.
            kinds = [kind for kind, _ in blocks] if judged else None
            texts = [text for _, text in blocks] if judged else None
            rows.append((key, page_id, url, host_of(url), main, kinds, texts, outside))
        types = [pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string()]
        types += [pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.string())]
        names = ["key", "page_id", "url", "host", "main", "kinds", "texts", "outside"]
        columns = zip(*rows) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


PARSED = (
    "key binary, page_id long, url string, host string, main string, kinds array<int>, texts array<string>, outside array<string>"
)


def _suffixes(blocks: list[str], depth: int) -> list[bytes]:
    """The first `depth` tokens of every suffix of a stream that has as many, as sortable bytes."""
    tokens = [xxhash.xxh32_digest(w) for text in blocks for w in text.split()]
    return [b"".join(tokens[i : i + depth]) for i in range(len(tokens) - depth + 1)]


def _stream(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, keys, found = [], [], []
            for host, key, blocks in zip(*(batch.column(c).to_pylist() for c in ("host", "key", "outside"))):
                distinct = list(dict.fromkeys(_suffixes(blocks, depth)))
                hosts += [host] * len(distinct)
                keys += [key] * len(distinct)
                found += distinct
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(keys, pa.binary()), pa.array(found, pa.binary())], ["host", "key", "suffix"]
            )

    return run


def _judge(depth: int):
    """The text of pages with blocks to judge, given the repeated suffixes that start in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            texts = []
            for kinds, blocks, repeated in zip(rows["kinds"], rows["texts"], rows["repeated"]):
                repeated = set(repeated or ())
                outside = [b for k, b in zip(kinds, blocks) if k != MAIN]
                suffixes = _suffixes(outside, depth)
                covered = np.zeros(len(suffixes) + depth, bool)
                for i, suffix in enumerate(suffixes):
                    if suffix in repeated:
                        covered[i : i + depth] = True
                out, at = [], 0
                for kind, block in zip(kinds, blocks):
                    if kind == MAIN:
                        out.append(block)
                        continue
                    words = block.split()
                    hit = covered[at : at + len(words)]
                    at += len(words)
                    if kind == OPEN and not hit.all():
                        out.append(block)
                texts.append("\n".join(out))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["page_id"], pa.int64()), pa.array(rows["url"], pa.string()), pa.array(texts, pa.string())],
                ["page_id", "url", "text"],
            )

    return run


def extract_main_text(pages: DataFrame, depth: int = DEPTH) -> DataFrame:
    """page_id, url and the main text of every page."""
    scratch = Scratch(pages.sparkSession, "html")
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    parsed = scratch.write(source.mapInArrow(_parse, PARSED), "parsed")
    streams = parsed.select("host", "key", "outside").mapInArrow(_stream(depth), "host string, key binary, suffix binary")
    classes = streams.groupBy("host", "suffix").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    repeated = classes.where("low <> high").select("host", "suffix")
    judged = parsed.where("kinds IS NOT NULL")
    asked = judged.select("host", "key", "outside").mapInArrow(_stream(depth), "host string, key binary, suffix binary")
    covered = (
        asked.join(repeated, ["host", "suffix"]).groupBy("key").agg(F.collect_set("suffix").alias("repeated"))
    )
    decided = judged.select("key", "page_id", "url", "kinds", "texts").join(covered, "key", "left")
    decided = decided.mapInArrow(_judge(depth), "page_id long, url string, text string")
    plain = parsed.where("kinds IS NULL").select("page_id", "url", F.col("main").alias("text"))
    return plain.unionByName(decided)
