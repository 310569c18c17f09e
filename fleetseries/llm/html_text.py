"""Main text of web pages: markup zones, and a suffix array of each host's other text.

Markup splits a page into blocks of three zones: the article (inside an
article or main element and in no menu, footer, form, advert, ... there),
chrome (menus, headers, footers, sidebars, notices, adverts, forms, reader
comments, by element, role or class) and the rest. Chrome is no text. Of the
article and of the rest the host's other pages decide what is text.

The article is compared with the host's other articles: their token streams are
concatenated and suffix-sorted, and a run of at least ``MIN_RUN`` tokens is
boilerplate if it occurs in ``SHARE`` of the host's different articles, and in
``ARTICLES`` at least (two may quote each other).

The rest is compared with chrome and rest, whether or not the page has an
article (the title may be marked and the body not): there a run is boilerplate
if it occurs on ``SHARE`` of the host's different pages that have a rest, and on
two at least. Covered tokens go, the others stay; on a page with an article,
unmarked blocks of fewer tokens than a run, of which the array says nothing, go
too.

A host may hold a third of all pages, so its pages are dealt to chunks of
bounded size, each with a suffix array of its own. For the rest, chunks exchange
the hashes of their distinct runs of ``MIN_RUN`` tokens with the pages that have
them (a longer repeated run is a chain of those). Articles are most of a page,
so of their runs a chunk gives only those that ``SHARE`` of its own articles
have: a run of that share of all has it in some chunk. What its chunks leave
open is counted in all of them. Pages with equal streams count as one page, and
so do near copies (``NEAR`` percent of their words; of n articles that are near
copies each counts as an n-th), so copies of a page do not turn its text into
boilerplate.
"""

from __future__ import annotations

import html
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetseries.session import broadcast_if_small, write_table

from .common import SPACED_WORD, Words, mix, small_batches, table, text_batches
from .components import connected
from .queries import query

#: Shortest run of tokens that counts as repeated.
MIN_RUN = 8
#: Pages of one suffix array, and bytes of their text.
CHUNK_PAGES = 2000
CHUNK_BYTES = 8 << 20
#: Share of a host's different pages that have a run of its boilerplate.
SHARE = 0.25
#: Different articles of a host, at least, that have a run of its boilerplate.
ARTICLES = 3
#: What sums of n-ths may be off by.
OFF = 1e-6
#: Percent of their distinct words that near copies share; minima a band of their sketch joins, and bands.
NEAR = 90
BAND, BANDS = 8, 8

ARTICLE, REST, CHROME = 0, 1, 2

# Elements and names of the HTML standard and common class names (fixed values).
RAW = frozenset("script style template noscript svg math textarea select iframe object canvas title audio video".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike"
    " strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME_ELEMENTS = frozenset("head nav footer aside form dialog menu button fieldset label".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
CHROME_NAMES = (
    "ad|ads|advert|adverts|advertisement|sponsor|sponsored|promo|promotion|banner|cookie|cookies|consent|gdpr|notice|notices"
    "|newsletter|subscribe|subscription|signup|popup|modal|overlay|sidebar|sidebars|widget|widgets|menu|navbar|nav|navigation"
    "|breadcrumb|breadcrumbs|pagination|pager|footer|comment|comments|disqus|respond|reply|replies|share|sharing|social|related"
    "|recommended|login|search|toolbar|skip"
)
_PAGE_ONLY_NAMES = "header|masthead|topbar"
_NAMED = re.compile(rf"(?:^|\s)(?!(?:has|no|with|without)[-_])(?:(?:{CHROME_NAMES})(?=[-_\s]|$)|[^\s]*[-_](?:{CHROME_NAMES})(?=\s|$))")
_NAMED_PAGE = re.compile(rf"(?:^|\s)(?:(?:{_PAGE_ONLY_NAMES})(?=[-_\s]|$)|[^\s]*[-_](?:{_PAGE_ONLY_NAMES})(?=\s|$))")
_IN_TAG = "[^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*"
_TOKEN = re.compile(
    rf"<(/?)([a-zA-Z][^\s/>]*)({_IN_TAG})>|<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S
)
_RAW_END = {tag: re.compile(rf"</{tag}\s*>|\Z", re.I) for tag in RAW}
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop|hidden|style|aria-hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)


def _zone(tag: str, attributes: str, within: int) -> int:
    """The zone of an element that lies in a zone."""
    if within == CHROME or tag in CHROME_ELEMENTS or (tag == "header" and within != ARTICLE):
        return CHROME
    article = tag in ("article", "main")
    if attributes and tag not in ("html", "body"):
        found = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)}
        names = f"{found.get('class', '')} {found.get('id', '')}"
        if (
            found.get("role") in CHROME_ROLES
            or "hidden" in found
            or found.get("aria-hidden") == "true"
            or "display:none" in found.get("style", "").replace(" ", "")
            or (not article and (_NAMED.search(names) or (within != ARTICLE and _NAMED_PAGE.search(names))))
        ):
            return CHROME
        article |= found.get("role") in ("main", "article") or "articlebody" in found.get("itemprop", "")
    return ARTICLE if article else within


def _decoded(text: str) -> str:
    return html.unescape(text) if "&" in text else text


def blocks(page: str) -> list[tuple[int, str]]:
    """(zone, text) of the blocks of a page that have text, in page order."""
    out: list[tuple[int, str]] = []
    open_: list[tuple[str, int]] = []
    zone, at = REST, 0
    held: list[str] = []

    def close():
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            out.append((zone, text))

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            held.append(_decoded(page[at : m.start()]))
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if tag in RAW and not (m[1] or m[4]):
            at = _RAW_END[tag].search(page, at).end()
            held.append(" ")
            continue
        if tag in VOID:
            if tag == "br":
                held.append(" ")
            elif tag == "hr":
                close()
            continue
        if m[1] or m[4]:
            known = [k for k, (name, _) in enumerate(open_) if name == tag]
            if known or tag not in INLINE:
                close()
            if known:
                del open_[known[-1] :]
                zone = open_[-1][1] if open_ else REST
            continue
        own = _zone(tag, m[3] or m[6] or "", zone)
        if tag in INLINE and own == zone:
            continue
        close()
        if tag == "body":
            open_.clear()
            own = REST
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and own == zone:
            continue  # their end tags are often left out; they change nothing
        open_.append((tag, own))
        zone = own
    if at < len(page):
        held.append(_decoded(page[at:]))
    close()
    return out


def host_of(url: str | None) -> str:
    return re.sub(r"^[^/]*//|[/?#].*$", "", url or "", flags=re.S).rpartition("@")[2].lower()


def _open(found: list[tuple[int, str]]) -> bool:
    """Whether the host decides what the text of a page is: it has a rest, or no article."""
    zones = {zone for zone, _ in found}
    return REST in zones or ARTICLE not in zones


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, str | None, list[tuple[int, str]]]]]:
    """(page_id, url, blocks) of the pages of a batch."""
    for part in text_batches(batches, "html"):
        yield [(page, url, blocks(text)) for page, url, text in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html")))]


def _batch(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _texts(found: list[tuple[int, str]], *zones: int) -> list[str]:
    return [t for z, t in found if z in zones]


def _article(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The article's blocks of the pages that have an article and no rest."""
    for part in _parsed(batches):
        rows = []
        for page, url, found in part:
            if not _open(found):
                own = _texts(found, ARTICLE)
                rows.append((page, url, host_of(url), [ARTICLE] * len(own), own))
        yield from _batch(rows, _BLOCKS)


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of each different article of a host; a task gives equal ones once."""
    seen = set()
    for part in _parsed(batches):
        rows = []
        for _, url, found in part:
            own = _texts(found, ARTICLE)
            key = (host_of(url), _stream_name(own)) if own else None
            if own and key not in seen:
                seen.add(key)
                rows.append((*key, own))
        yield from _batch(rows, _STREAMS)


def _article_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes of the distinct words of each different article."""
    for part in _streams(batches):
        rows = [(host, name, _words(texts).view(np.int64)) for host, name, texts in zip(*(c.to_pylist() for c in part.columns))]
        yield from _batch(rows, _ARTICLE_WORDS)


_TEXT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])
_BLOCKS = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("zones", pa.list_(pa.int32())), ("texts", pa.list_(pa.string()))]
)
_BLOCKS_TYPE = "page_id long, url string, host string, zones array<int>, texts array<string>"
_STREAMS = pa.schema([("host", pa.string()), ("name", pa.int64()), ("texts", pa.list_(pa.string()))])
_ARTICLE_WORDS = pa.schema([("host", pa.string()), ("name", pa.int64()), ("words", pa.list_(pa.int64()))])
_OTHER = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("open", pa.bool_())]
    + [("zones", pa.list_(pa.int32())), ("texts", pa.list_(pa.string())), ("name", pa.int64())]
    + [("words", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))]
    + [("size", pa.int64()), ("article", pa.int64()), ("article_bands", pa.list_(pa.int64()))]
)
_OTHER_TYPE = (
    "page_id long, url string, host string, open boolean, zones array<int>, texts array<string>, name long,"
    " words array<long>, bands array<long>, size long, article long, article_bands array<long>"
)
_SALTS = mix(np.arange(1, BAND * BANDS + 1, dtype=np.uint64))


def _sketch(texts: list[str]) -> tuple[list[int], list[int]]:
    """Hashes of the distinct words, and the bands of their sketch: sets with an equal band may be near copies."""
    words = _words(texts)
    if not len(words):
        return [], []
    least = np.array([mix(words ^ salt).min() for salt in _SALTS])
    return words.view(np.int64).tolist(), _bands(least[None, :])[0]


def _words(texts: list[str]) -> np.ndarray:
    """Hashes of the distinct words."""
    return np.array([_word_hash(w) for w in {w for t in texts for w in t.split()}], dtype=np.uint64)


def _bands(least: np.ndarray) -> list[list[int]]:
    """The bands of sketches (one a row)."""
    least = least.reshape(-1, BANDS, BAND)
    bands = np.tile(np.arange(BANDS, dtype=np.uint64), (len(least), 1))
    for k in range(BAND):
        bands = mix(bands * np.uint64(31) + least[:, :, k])
    return bands.view(np.int64).tolist()


def _article_bands(texts: list[str]) -> list[list[int]]:
    """The bands of each text. A word's hash names one place of the sketch, so all words are looked at once for all
    places; an empty place takes the next one's value."""
    words = Words(texts, SPACED_WORD)
    own = np.repeat(np.arange(len(texts)) * len(_SALTS), np.diff(words.first))
    place = own + (words.hash % np.uint64(len(_SALTS))).astype(np.int64)
    none = np.uint64(2**64 - 1)
    least = np.full(len(texts) * len(_SALTS), none)
    np.minimum.at(least, place, words.hash // np.uint64(len(_SALTS)))
    least = least.reshape(len(texts), len(_SALTS))
    step = 1
    while step < len(_SALTS):
        following = np.roll(least, -step, axis=1)
        least = np.where((least == none) & (following != none), mix(following ^ np.uint64(step)), least)
        step *= 2
    return _bands(least)


def _stream_name(texts: list[str]) -> int:
    """A number for a page's stream: equal streams have the same one."""
    return _word_hash.__wrapped__(" ".join(texts)) >> 1


def _other(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chrome of every page; of those with a rest, or no article (``open``), all blocks and the sketch of their words.

    Of the article its name and sketch, of all blocks their size.
    """
    for part in _parsed(batches):
        rows = []
        for page, url, found in part:
            open_ = _open(found)
            own = found if open_ else [b for b in found if b[0] != ARTICLE]
            name = _stream_name(_texts(found, REST, CHROME))
            sketch = _sketch(_texts(found, ARTICLE, REST)) if open_ else (None, None)
            marked = _texts(found, ARTICLE)
            article = _stream_name(marked) if marked else None
            size = sum(len(t.encode("utf-8", "surrogatepass")) for _, t in found)
            rows.append((page, url, host_of(url), open_, [z for z, _ in own], [t for _, t in own], name, *sketch, size, article))
        bands = _article_bands([" ".join(_texts(found, ARTICLE)) for _, _, found in part])
        yield from _batch([(*row, own if row[-1] is not None else None) for row, own in zip(rows, bands)], _OTHER)


class Streams:
    """Token streams of pages one after another, and their suffix array up to ``run`` tokens."""

    def __init__(self, texts: list[list[str]], run: int):
        ids: dict[str, int] = defaultdict(count().__next__)
        flat, block_sizes, sizes = array("q"), array("q"), []
        for page in texts:
            before = len(flat)
            for text in page:
                words = text.split()
                flat.extend(map(ids.__getitem__, words))
                block_sizes.append(len(words))
            sizes.append(len(flat) - before)
        self.tokens = np.array(flat, dtype=np.int64)
        self.block_sizes = np.array(block_sizes, dtype=np.int64)
        self.page = np.repeat(np.arange(len(texts)), sizes)
        self.ends = np.repeat(np.cumsum(sizes, dtype=np.int64), sizes)
        self.whole = np.arange(len(self.tokens)) + run <= self.ends
        self.words = list(ids)
        self.run = run

    def sort(self, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """The suffix array: positions of whole runs in their order, and their ranks (equal runs have one).

        Prefix doubling, by the first 1, 2, 4, ... tokens. A run that starts ``least`` times has prefixes that do, so
        suffixes whose prefix is rarer are not sorted further.
        """
        at, rank, size = np.arange(len(self.tokens)), self.tokens, len(self.words)
        width = 1
        while width < self.run:
            step = min(width, self.run - width)
            width += step
            at = at[at + width <= self.ends[at]]
            at = at[(rank[at] >= 0) & (rank[at + step] >= 0)]
            both = rank[at] * size + rank[at + step]
            order = np.argsort(both)
            at, both = at[order], both[order]
            new = np.ones(len(at), dtype=np.int64)
            new[1:] = both[1:] != both[:-1]
            found = np.cumsum(new) - 1
            size = int(new.sum())
            often = np.bincount(found)[found] >= least if len(at) else np.empty(0, dtype=bool)
            at = at[often]
            rank = np.full(len(self.tokens), -1, dtype=np.int64)
            rank[at] = found[often]
        at = at[self.whole[at]]
        order = np.argsort(rank[at], kind="stable") if self.run == 1 else slice(None)
        return at[order], rank[at[order]]

    def run_hashes(self, at: np.ndarray) -> np.ndarray:
        """Hash of the run of tokens that starts at each position, the same in every chunk."""
        used = np.zeros(len(self.words), dtype=bool)
        for k in range(self.run):
            used[self.tokens[at + k]] = True
        letters = np.zeros(len(self.words), dtype=np.uint64)
        letters[used] = [_word_hash(self.words[i]) for i in np.flatnonzero(used)]
        h = np.zeros(len(at), dtype=np.uint64)
        for k in range(self.run):
            h = mix(h * np.uint64(31) + letters[self.tokens[at + k]])
        return h.view(np.int64)


@lru_cache(maxsize=1 << 16)
def _word_hash(word: str) -> int:
    from hashlib import blake2b

    return int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _stream_texts(pages: pa.Table) -> list[list[str]]:
    """The blocks of each page's stream: all but the article's."""
    both = zip(pages.column("zones").to_pylist(), pages.column("texts").to_pylist())
    return [[t for z, t in zip(zones, texts) if z != ARTICLE] for zones, texts in both]


def _different(pages: pa.Table, side: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The different articles of a chunk, and what each counts."""
    pages = pages.take(np.unique(pages.column("name").to_numpy(), return_index=True)[1])
    names = pages.column("name").to_numpy()
    shared = side.filter(pc.is_valid(side.column("name")))
    known = shared.column("name").to_numpy()
    order = np.argsort(known)
    at = np.minimum(np.searchsorted(known[order], names), max(len(known) - 1, 0))
    counts = np.ones(len(names))
    if len(known):
        near = known[order][at] == names
        counts[near] = shared.column("part").to_numpy()[order][at][near]
    return pages, counts


def _counted(streams: Streams, at: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """By run (``ids`` of those that start at positions ``at``) what the articles with it count."""
    found = np.unique(ids * len(counts) + streams.page[at])
    return np.bincount(found // len(counts), weights=counts[found % len(counts)]).astype(np.float64)


def _frequent(run: int):
    """The runs that ``SHARE`` of a chunk's articles have; of a host of one chunk, its boilerplate."""

    def work(key: tuple, pages: pa.Table, side: pa.Table) -> pa.Table:
        hashes, n, total = np.empty(0, dtype=np.int64), np.empty(0), 0.0
        if len(pages):
            alone = pages.column("chunks")[0].as_py() == 1
            pages, counts = _different(pages, side)
            total = float(counts.sum())
            least = max(ARTICLES, np.ceil(SHARE * total - OFF)) if alone else SHARE * total
            streams = Streams(pages.column("texts").to_pylist(), run)
            # neighbours in the suffix array have equal runs; an article counts one at most
            at, rank = streams.sort(int(np.ceil(least - OFF)))
            first = np.ones(len(at), dtype=bool)
            first[1:] = rank[1:] != rank[:-1]
            n = _counted(streams, at, np.cumsum(first) - 1, counts)
            kept = n >= least - OFF
            hashes, n = streams.run_hashes(at[first][kept]), n[kept]
        host = pa.array([key[0].as_py()] * len(n), pa.string())
        return pa.table({"host": host, "run": pa.array(hashes), "n": pa.array(n), "total": pa.array(np.full(len(n), total))})

    return work


def _recount(run: int):
    """What the articles of a chunk with each of the given runs count."""

    def work(key: tuple, pages: pa.Table, side: pa.Table) -> pa.Table:
        runs = np.unique(side.column("run").drop_null().to_numpy())
        n = np.empty(0)
        if len(pages) and len(runs):
            pages, counts = _different(pages, side)
            streams = Streams(pages.column("texts").to_pylist(), run)
            at = np.flatnonzero(streams.whole)
            hashes = streams.run_hashes(at)
            ids = np.minimum(np.searchsorted(runs, hashes), len(runs) - 1)
            known = runs[ids] == hashes
            n = _counted(streams, at[known], ids[known], counts)
        host = pa.array([key[0].as_py()] * len(n), pa.string())
        return pa.table({"host": host, "run": pa.array(runs[: len(n)]), "n": pa.array(n)})

    return work


def _runs(run: int):
    """The distinct runs of a chunk with the names of the pages that have them."""

    def work(key: tuple, pages: pa.Table) -> pa.Table:
        streams = Streams(_stream_texts(pages), run)
        names = pages.column("name").to_numpy()
        at, rank = streams.sort()
        # neighbours in the suffix array have equal runs; of those with one name the first is given
        order = np.lexsort((names[streams.page[at]], rank)) if len(at) else at
        rank, name = rank[order], names[streams.page[at]][order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (rank[1:] != rank[:-1]) | (name[1:] != name[:-1])
        n = int(new.sum())
        return pa.table(
            {
                "host": pa.array([key[0].as_py()] * n, pa.string()),
                "chunk": pa.array([key[1].as_py()] * n, pa.int64()),
                "run": pa.array(streams.run_hashes(at[order][new])),
                "name": pa.array(name[new], pa.int64()),
            }
        )

    return work


def _covered(starts: np.ndarray, run: int, size: int) -> np.ndarray:
    """Which of ``size`` positions lie in a run that starts at one of ``starts``."""
    edge = np.zeros(size + run + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + run, -1)
    return np.cumsum(edge)[:size] > 0


def _gone(texts: list[list[str]], known: np.ndarray, run: int) -> list[bool] | None:
    """Which tokens of the streams the known runs cover; None if there are no such runs."""
    if not len(known):
        return None
    streams = Streams(texts, run)
    starts = np.flatnonzero(streams.whole)
    starts = starts[np.isin(streams.run_hashes(starts), known)]
    block = np.repeat(np.arange(len(streams.block_sizes)), streams.block_sizes)
    inside = starts[block[starts] == block[starts + run - 1]]
    anywhere, within = (_covered(at, run, len(block)) for at in (starts, inside))
    # a run may begin in a menu and end in the common opening of a text: a block that is covered as a whole goes,
    # of another block only what runs inside it cover
    ends = np.cumsum(streams.block_sizes)
    total = np.concatenate([[0], np.cumsum(anywhere)])
    whole = total[ends] - total[ends - streams.block_sizes] == streams.block_sizes
    return (within | np.repeat(whole, streams.block_sizes)).tolist()


def _unique(run: int):
    """The unique runs of article and rest of each page."""

    def work(key: tuple, pages: pa.Table, repeated: pa.Table) -> pa.Table:
        blocks_ = [list(zip(*both)) for both in zip(pages.column("zones").to_pylist(), pages.column("texts").to_pylist())]
        marked = repeated.column("marked").to_numpy(zero_copy_only=False).astype(bool)
        runs = repeated.column("run").to_numpy()
        gone = {
            True: _gone([_texts(b, ARTICLE) for b in blocks_], np.unique(runs[marked]), run),
            False: _gone([_texts(b, REST, CHROME) for b in blocks_], np.unique(runs[~marked]), run),
        }
        out, at = [], {True: 0, False: 0}
        for found in blocks_:
            kept = []
            least = run if any(zone == ARTICLE for zone, _ in found) else 0
            for zone, text in found:
                words = text.split()
                own = zone == ARTICLE
                start, at[own] = at[own], at[own] + len(words)
                if zone == CHROME or (zone == REST and len(words) < least):
                    continue
                drops = gone[own]
                kept += words if drops is None else [w for w, drop in zip(words, drops[start : at[own]]) if not drop]
            out.append(" ".join(kept))
        return pa.table({"page_id": pages.column("page_id"), "url": pages.column("url"), "text": pa.array(out, pa.string())}).cast(_TEXT)

    return work


def _pairs(banded: DataFrame) -> DataFrame:
    """(host, name, first) of pages (host, name, bands) that may be near copies: those of one band meet its least page."""
    banded = banded.select("host", "name", F.posexplode("bands").alias("band", "value")).distinct()
    first = banded.groupBy("host", "band", "value").agg(F.min("name").alias("first"))
    return banded.join(first, ["host", "band", "value"]).where("name <> first").select("host", "name", "first").distinct()


def _linked(pairs: DataFrame, pages: DataFrame) -> DataFrame:
    """(name, label): pairs that share ``NEAR`` percent of their words (``pages``: host, name, words), and what they connect."""
    of = pages.select("host", F.col("name").alias("first"), F.col("words").alias("__words"))
    both = F.size(F.array_intersect("words", "__words"))
    union = F.size("words") + F.size("__words") - both
    links = pairs.join(pages, ["host", "name"]).join(of, ["host", "first"]).where(100 * both >= NEAR * union)
    found = connected(write_table(links.select(F.col("name").alias("a"), F.col("first").alias("b")), "html-near"))
    return found.select(F.col("node").alias("name"), "label")


def near_copies(other: DataFrame) -> DataFrame:
    """(name, label) of the pages with a near copy on their host: near copies, and what they connect, have one label."""
    pages = other.where("open and size(words) > 0").groupBy("host", "name").agg(F.min_by("words", F.xxhash64("words")).alias("words"))
    return _linked(_pairs(other.where("open and size(words) > 0")), pages)


def near_articles(rows: DataFrame, other: DataFrame) -> DataFrame:
    """(name, label) of the articles with a near copy on their host. Only of articles that may have one the words are moved."""
    articles = other.where("article is not null").select("host", F.col("article").alias("name"), F.col("article_bands").alias("bands"))
    pairs = write_table(_pairs(articles), "html-pairs")
    if pairs.isEmpty():
        return rows.sparkSession.createDataFrame([], "name long, label long")
    met = pairs.select("host", "name").union(pairs.select("host", "first")).distinct().withColumnRenamed("name", "article")
    of = other.join(met, ["host", "article"]).groupBy("host", "article").agg(F.min(F.struct("page_id", "url")).alias("page"))
    of = write_table(of.select(F.col("page.page_id").alias("_id"), F.col("page.url").alias("_url")).distinct(), "html-met")
    same = F.col("page_id").eqNullSafe(F.col("_id")) & F.col("url").eqNullSafe(F.col("_url"))
    words = rows.join(broadcast_if_small(of), same, "left_semi").mapInArrow(_article_words, "host string, name long, words array<long>")
    return _linked(pairs, write_table(words.groupBy("host", "name").agg(F.first("words").alias("words")), "html-words"))


def _dealt(pages: DataFrame, chunks: DataFrame, key: Column) -> DataFrame:
    """``pages`` with the number of chunks of their host, and their own. Only hosts of several chunks are looked up: few,
    as each has more than ``CHUNK_PAGES`` pages or ``CHUNK_BYTES`` of text."""
    found = pages.join(F.broadcast(chunks.where("chunks > 1")), "host", "left")
    found = found.withColumn("chunks", F.coalesce("chunks", F.lit(1).cast("long")))
    return found.withColumn("chunk", F.pmod(key, F.col("chunks")))


def _of_all_chunks(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows of hosts, once for each of the host's chunks."""
    return found.join(chunks, "host").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).drop("chunks")


def repeated_in_articles(rows: DataFrame, other: DataFrame, chunks: DataFrame, run: int) -> DataFrame:
    """(host, run) of the runs that ``SHARE`` of the host's different articles have, and ``ARTICLES`` at least."""
    near = write_table(near_articles(rows, other), "html-near-articles")
    names = other.where("article is not null").select("host", F.col("article").alias("name")).distinct().join(near, "name", "left")
    hosts = names.groupBy("host").agg(F.count_distinct(F.coalesce("label", "name")).alias("different"))
    hosts = write_table(hosts.withColumn("needed", F.greatest(F.lit(ARTICLES), F.ceil(F.col("different") * SHARE))), "html-hosts")
    groups = names.where("label is not null").groupBy("host", "label").agg((1 / F.count("*")).alias("part"))
    parts = names.join(groups, ["host", "label"]).select("host", "name", "part")
    parts = _dealt(parts, chunks, F.col("name")).select("host", "chunk", "name", "part", F.lit(None).cast("long").alias("run"))
    parts = write_table(parts, "html-parts")
    articles = rows.mapInArrow(_streams, "host string, name long, texts array<string>")
    articles = _dealt(articles, chunks, F.col("name")).select("host", "chunk", "chunks", "name", "texts").groupBy("host", "chunk")
    frequent = articles.cogroup(parts.groupBy("host", "chunk")).applyInArrow(_frequent(run), "host string, run long, n double, total double")
    frequent = write_table(frequent, "html-frequent")
    frequent = frequent.groupBy("host", "run").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).join(hosts, "host")
    known = frequent.where(F.col("n") >= F.col("needed") - OFF).select("host", "run")
    # the chunks that do not give a run have it in less than their share
    most = F.col("n") + SHARE * (F.col("different") - F.col("total"))
    unsure = frequent.where((F.col("n") < F.col("needed") - OFF) & (most >= F.col("needed") - OFF)).select("host", "run")
    unsure = write_table(unsure, "html-unsure")
    if unsure.isEmpty():
        return known
    side = parts.unionByName(_of_all_chunks(unsure, chunks), allowMissingColumns=True)
    counted = articles.cogroup(side.groupBy("host", "chunk")).applyInArrow(_recount(run), "host string, run long, n double")
    counted = counted.groupBy("host", "run").agg(F.sum("n").alias("n")).join(hosts, "host")
    return known.union(counted.where(F.col("n") >= F.col("needed") - OFF).select("host", "run"))


def main_text(pages: DataFrame, run: int = MIN_RUN, chunk_pages: int = CHUNK_PAGES) -> DataFrame:
    """Rows page_id, url, text: the main text of every row of ``pages`` (page_id, url, html).

    The article and the rest of a page, each without what its host repeats.
    Character references are decoded, white space inside a block becomes one
    space, blocks are joined by one space in page order. Null or empty html,
    and pages that hold nothing but chrome, have an empty text. A null url is a
    host of its own name (empty). Repeated rows give a row each; extra columns
    are not read.
    """
    spark = pages.sparkSession
    small_batches(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    other = write_table(rows.mapInArrow(_other, _OTHER_TYPE), "html-other")
    n = F.greatest(F.ceil(F.count("*") / chunk_pages), F.ceil(F.sum("size") / CHUNK_BYTES))
    chunks = write_table(other.groupBy("host").agg(n.alias("chunks")), "html-chunks")
    marked = write_table(repeated_in_articles(rows, other, chunks, run), "html-marked")
    dealt = _dealt(other, chunks, F.xxhash64("page_id", "texts")).select("page_id", "url", "host", "open", "zones", "texts", "name", "chunk")
    # equal streams are one page, whichever of them a chunk holds: they have one name
    runs = write_table(
        dealt.select("host", "chunk", "zones", "texts", "name").groupBy("host", "chunk").applyInArrow(
            _runs(run), "host string, chunk long, run long, name long"
        ),
        "html-runs",
    )
    same = near_copies(other)
    one = F.coalesce("label", "name").alias("one")
    different = other.where("open").select("host", "name").distinct().join(same, "name", "left").select("host", one).distinct()
    needed = different.groupBy("host").agg(F.greatest(F.lit(2), F.ceil(F.count("*") * SHARE)).alias("needed"))
    found = runs.join(needed, "host").select("host", "run", "name", "needed").distinct().join(same, "name", "left")
    found = found.groupBy("host", "run").agg(F.count_distinct(one).alias("pages"), F.first("needed").alias("needed"))
    repeated = found.where("pages >= needed")
    open_ = dealt.where("open").select("host", "chunk", "page_id", "url", "zones", "texts")
    wanted = runs.select("host", "chunk", "run").distinct().join(repeated.select("host", "run"), ["host", "run"], "left_semi")
    wanted = wanted.join(open_.select("host", "chunk").distinct(), ["host", "chunk"], "left_semi")
    wanted = wanted.select("host", "chunk", "run", F.lit(False).alias("marked"))
    wanted = wanted.union(_of_all_chunks(marked, chunks).select("host", "chunk", "run", F.lit(True).alias("marked")))
    # a row that comes very often is dealt by the task that read it, too
    key = F.xxhash64("page_id", "texts", F.spark_partition_id())
    closed = _dealt(rows.mapInArrow(_article, _BLOCKS_TYPE), chunks, key).select(*open_.columns)
    return open_.union(closed).groupBy("host", "chunk").cogroup(wanted.groupBy("host", "chunk")).applyInArrow(
        _unique(run), "page_id long, url string, text string"
    )


@query("op5_html_text")
def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
