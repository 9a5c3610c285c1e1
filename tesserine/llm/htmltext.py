"""Operator 1, HTML extraction: nearest-URL page differencing.

Pages are parsed into text lines, one per block.  Lines of elements that are by
their kind no article text (menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles, reader comments) are dropped.  Then pages are sorted by
host and URL path, every page is paired with its nearest neighbours on the same
host, the lines are aligned by longest common subsequence, and shared lines are
deleted.  Lines inside an article element are never deleted: pages often carry
the same passage, and that passage is article text of each of them.  (Measured on
sf0.1: differencing would delete 316 article lines on 217 of 2,500 pages.)

What is left: the lines of article elements, and all other lines that no
neighbour shares.  A page that has all lines of a page is a copy of it and not its
template; the nearest page on either side that is no copy is the neighbour.  At the
first and last page of a host both neighbours are from the one side.  Lines of a
neighbour that shares more than half of a page's text are deleted only if the other
neighbour, where there is one, shares them as well: it may differ from the page in
a date only.

The sorted pages are divided into ranges by sampled keys.  A first pass over the
hashes of the lines writes the pages at the edges of each range to files, which the tasks
of the ranges beside it read as far as they need them, so the text does not depend on how the
pages are divided.

The header of an article is part of it, as are footer and aside in a quotation inside it.
An article named as a comment, a reply or a card of another page is none.

Defined results: a null or empty html gives an empty text; a page without lines is
no neighbour; a null URL is a host of its own; repeated rows are pages of their own,
with equal results; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import html as entities
import pickle
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, shared_dir
from .store import Source, new_file, write

# Element names by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Only these begin and end lines; all others, unknown ones too, stand inside a line.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noframes ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
DROPPED = frozenset("head nav header footer aside form script style noscript template iframe svg button select textarea dialog menu object canvas video audio fieldset".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = frozenset("article main section div body html table ul ol dl nav header footer aside form blockquote".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
RAW = frozenset("script style textarea title noscript iframe".split())
# Words of class and id names.  A name marks what is no article text if
# one of its words is in NAMES and all others are there or in BESIDE; the words of EDGES
# are so common inside articles that they count alone or beside the words of SITE only.
NAMES = frozenset(
    "nav navbar navigation menu submenu sidebar aside ad ads adv advert adverts advertisement advertising adslot adsense sponsor sponsored promo promotion cookie cookies consent gdpr newsletter subscribe subscription signup login share sharing related recommended recommendations trending breadcrumb breadcrumbs pagination pager comment comments commentlist disqus reply replies respond popup modal skiplink copyright disclaimer".split()
)
EDGES = frozenset("header masthead footer banner notice notices notification social overlay discussion widget toolbar".split())
SITE = frozenset("site page global main top bottom left right container wrapper wrap bar box area fixed sticky cookie cookies".split())
BESIDE = SITE | EDGES | frozenset("primary secondary inner outer list links link item items block section panel slot unit form button buttons icons thread article articles post posts story stories news user users reader readers card cards body".split())
# Elements whose class and id names count: no text of an article goes for the name of its own line.
CONTAINERS = BLOCKS - frozenset("html body article main p h1 h2 h3 h4 h5 h6 pre br hr title".split())

NAME = re.compile(r"[A-Za-z][^\s/>]*")
QUOTED = re.compile(r"=\s*([\"'])")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
ATTRIBUTE = re.compile(r"""([A-Za-z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
LONG_REFERENCE = re.compile(r"&#(\d{8,});?")

FREE, MAIN, ARTICLE = 1, 2, 3


def _marks(name: str) -> bool:
    """Does a class or id name mark what is no article text?"""
    words = [w.lower() for w in NAME_WORD.findall(name)]
    if any(w in NAMES for w in words):
        return all(w in NAMES or w in BESIDE for w in words)
    return any(w in EDGES for w in words) and all(w in EDGES or w in SITE for w in words)


def _marks_article(name: str, nested: bool) -> bool:
    """The same for an article: one word is enough inside another article, else all words have to say so."""
    words = [w.lower() for w in NAME_WORD.findall(name)]
    return any(w in NAMES for w in words) and (nested or all(w in NAMES or w in BESIDE for w in words))


def _unwanted(name: str, attributes: str, kind: int, quoted: bool) -> bool:
    """Does an element by its name or attributes hold no article text?

    The header of an article (or main part) is its headline, and footer or aside in a
    quotation in it are part of the quotation.
    """
    inside = kind != FREE and (name == "header" or (quoted and name in ("footer", "aside")))
    if name in DROPPED and not inside:
        return True
    if not attributes.strip() or name in ("html", "body", "main"):
        return False
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), next((v for v in values if v), "")
        if name == "article":
            # a comment or a card of another page is often an article of its own
            if key in ("class", "id") and any(_marks_article(v, kind == ARTICLE) for v in value.split()):
                return True
            continue
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "role" and value.lower() in ROLES) or (key == "style" and HIDDEN.search(value)):
            return True
        if key in ("class", "id") and name in CONTAINERS and any(map(_marks, value.split())):
            return True
    return False


def _decoded(text: str) -> str:
    """Character references decoded; the decoder refuses numbers of very many digits."""

    def short(m: re.Match) -> str:
        digits = m[1].lstrip("0")
        return "\ufffd" if len(digits) > 7 else f"&#{digits or 0};"

    return entities.unescape(LONG_REFERENCE.sub(short, text)) if "&" in text else text


class _Open:
    """The open elements, counted in all and since the last fence, so that no search goes over those that it does not close."""

    def __init__(self):
        self._stack: list[tuple[str, bool, int]] = []  # name, dropped, kind
        self._all: Counter[str] = Counter()
        self._near: list[Counter[str]] = [Counter()]

    @property
    def dropped(self) -> bool:
        return bool(self._stack) and self._stack[-1][1]

    @property
    def kind(self) -> int:
        return self._stack[-1][2] if self._stack else FREE

    def holds(self, name: str) -> bool:
        return self._all[name] > 0

    def push(self, name: str, dropped: bool, kind: int) -> None:
        self._stack.append((name, dropped, kind))
        self._all[name] += 1
        if name in FENCES:
            self._near.append(Counter())
        else:
            self._near[-1][name] += 1

    def _pop(self) -> str:
        name = self._stack.pop()[0]
        self._all[name] -= 1
        if name in FENCES:
            self._near.pop()
        else:
            self._near[-1][name] -= 1
        return name

    def close(self, name: str) -> None:
        """A block is closed over fences, all else up to the last fence."""
        far = name in BLOCKS and name != "p" and name not in SIBLINGS
        if (self._all if far else self._near[-1])[name]:
            while self._pop() != name:
                pass

    def close_all(self, names: Iterable[str]) -> None:
        for name in names:
            while self._near[-1][name]:
                self.close(name)


def _tag_end(source: str, at: int, unclosed: dict[str, int]) -> int:
    """Where a tag's > is, quoted values skipped; -1 if there is none.  unclosed: from where on a quote has no second one."""
    while True:
        end = source.find(">", at)
        quote = QUOTED.search(source, at, end) if end >= 0 else None
        if not quote:
            return end
        mark, begin = quote[1], quote.end()
        close = -1 if begin >= unclosed.get(mark, len(source)) else source.find(mark, begin)
        if close < 0:
            unclosed[mark] = min(begin, unclosed.get(mark, begin))
            return end
        at = close + 1


def lines_of(source: str) -> list[tuple[int, str]]:
    """Kind and text of each line of a page, without what elements rule out by their kind; in time linear in the page."""
    out: list[tuple[int, str]] = []
    held: list[str] = []
    opened, unclosed = _Open(), {}
    at, begin, end = 0, 0, len(source)  # begin: where the search for the next < goes on

    def hold(to: int) -> None:
        if to > at and not opened.dropped:
            held.append(source[at:to])

    def close_line() -> None:
        if held:
            text = " ".join(_decoded("".join(held)).split())
            held.clear()
            if text:
                out.append((opened.kind, text))

    while at < end:
        lt = source.find("<", begin)
        if lt < 0:
            hold(end)
            break
        mark = source[lt + 1 : lt + 2]
        if mark in ("!", "?"):
            for head, tail in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<", ">")):
                if source.startswith(head, lt):
                    stop = source.find(tail, lt + len(head))
                    break
            hold(lt)
            at = begin = end if stop < 0 else stop + len(tail)
            continue
        closing = mark == "/"
        m = NAME.match(source, lt + 1 + closing)
        stop = _tag_end(source, m.end(), unclosed) if m else -1
        if not m:
            begin = lt + 1
            continue
        hold(lt)
        if stop < 0:  # no > and so no tag after this
            at = lt
            hold(end)
            break
        name, attributes = m[0].lower(), source[m.end() : stop]
        at = begin = stop + 1
        if name in BLOCKS:
            close_line()
        if closing:
            opened.close(name)
            continue
        if name in RAW:
            found = RAW_END[name].search(source, at)
            stop = source.find(">", found.end()) if found else -1
            at = begin = end if stop < 0 else stop + 1
            continue
        if name in VOID or (name == "svg" and attributes.endswith("/")):
            continue
        if name in CLOSES_P or name in SIBLINGS:
            opened.close_all({"p"} | SIBLINGS.get(name, set()))
        dropped, kind = opened.dropped or _unwanted(name, attributes, opened.kind, opened.holds("blockquote")), opened.kind
        if name not in BLOCKS:
            if dropped:
                opened.push(name, True, kind)
            continue
        if name == "article" or "articlebody" in attributes.lower():
            kind = ARTICLE
        elif kind == FREE and (name == "main" or re.search(r"role\s*=\s*[\"']?main\b", attributes, re.I)):
            kind = MAIN
        opened.push(name, dropped, kind)
    close_line()
    return out


def shared_lines(mine: list[str], other: list[str]) -> set[int]:
    """Places in ``mine`` of one longest common subsequence of lines.

    Bit-parallel: one big integer per line of ``mine`` holds a row of the
    length table as differences; the places come from walking back.
    """
    common = set(mine) & set(other)
    a = [i for i, x in enumerate(mine) if x in common]
    b = [x for x in other if x in common]
    if not a:
        return set()
    where: dict[str, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, rows = full, []
    for i in a:
        hit = row & where[mine[i]]
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    out, i, j = set(), len(a), len(b)
    while i and j:
        if mine[a[i - 1]] == b[j - 1]:
            out.add(a[i - 1])
            i, j = i - 1, j - 1
        elif rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
    return out


def difference(kinds: list[int], texts: list[str], neighbours: list, lines: list | None = None) -> str:
    """The main text of a page, given its lines and those of its neighbours; ``lines``: hashes, if neighbours are given by hashes."""
    gone = _template(lines or texts, [len(t) for t in texts], neighbours)
    return "\n".join(t for i, (k, t) in enumerate(zip(kinds, texts, strict=True)) if k == ARTICLE or i not in gone)


def _template(mine: list, sizes: list[int], neighbours: list[list]) -> set[int]:
    """Places of the lines that neighbours share; lines may be given by their hashes."""
    shares, gone = [shared_lines(mine, n) for n in neighbours if not _holds(n, mine)], set()
    for same in shares:
        most = 2 * sum(sizes[i] for i in same) > sum(sizes)
        gone |= set.intersection(*shares) if most else same
    return gone


def _holds(page: Iterable, mine: Iterable) -> bool:
    """Does a page have every line of mine?"""
    return set(mine).issubset(page)


def _pick(mine: tuple, pages: Iterable[tuple], most: int, got: list[tuple]) -> list[tuple]:
    """``got`` and the next pages that are no copies of mine, nor of the one picked before, up to ``most``."""
    for page in pages if len(got) < most else ():
        if not _holds(page, mine) and not (got and _holds(page, got[-1])):
            got.append(page)
            if len(got) == most:
                break
    return got


class _Before:
    """Pages of one host from the last one back, each followed by the nearest before it that does not hold it whole.

    What is skipped holds the page that was tried, and so every page that this page holds.
    """

    def __init__(self):
        self.last = None

    def __iter__(self) -> Iterator[tuple]:
        node = self.last
        while node:
            yield node[0]
            node = node[1]

    def add(self, mine: tuple) -> None:
        node = self.last
        while node and _holds(node[0], mine):
            node = node[1]
        self.last = (mine, node)


#: Pages of each edge of a range that are read at once; the others stand in a second file, which is read if these do not do.
EDGE = 8
#: Files of edges that a task remembers.
RECALL = 8


@lru_cache(RECALL)
def _edge_file(uri: str) -> tuple[list[tuple], list[tuple]]:
    with Source(uri) as source:
        return pickle.loads(source.range(0, source.size()))


class _Edges(dict):
    """Range -> host of its start, host of its end, whether all of it is one host, and the files with the pages of both ends."""

    def _pages(self, k: int, end: int) -> Iterator[tuple]:
        for uri in self[k]["files"]:
            yield from _edge_file(uri)[end]

    def before(self, at: int, host: str) -> Iterator[tuple]:
        for k in sorted((k for k in self if k < at), reverse=True):
            if self[k]["last"] != host:
                return
            yield from self._pages(k, 1)
            if not self[k]["one"]:
                return

    def after(self, at: int, host: str) -> Iterator[tuple]:
        for k in sorted(k for k in self if k > at):
            if self[k]["first"] != host:
                return
            yield from self._pages(k, 0)
            if not self[k]["one"]:
                return


def with_neighbours(rows: Iterable[tuple], edges: _Edges) -> Iterator[tuple[list, list[tuple]]]:
    """(range, host, lines, page) in their order -> pages with equal lines, and their neighbours' lines."""
    at = host = None
    first, before, waiting = False, _Before(), {}

    def near(back: list[tuple], ahead: list[tuple]) -> list[tuple]:
        return back[:1] + ahead[:1] if back and ahead else back or ahead

    def leave(last: bool) -> Iterator[tuple]:
        for (mine, *_), (back, ahead, pages) in waiting.items():
            yield pages, near(back, _pick(mine, edges.after(at, host) if last else (), 1 if back else 2, ahead))
        waiting.clear()

    for k, h, mine, page in rows:
        if (k, h) != (at, host):
            yield from leave(k != at)
            first, at, host, before = k != at, k, h, _Before()
        if not mine:
            yield [page], []
            continue
        for key, (back, ahead, pages) in [*waiting.items()]:
            if len(_pick(key[0], [mine], 1 if back else 2, ahead)) == (1 if back else 2):
                del waiting[key]
                yield pages, near(back, ahead)
        key = (mine, *page[0])
        if key in waiting:
            waiting[key][2].append(page)
        else:
            waiting[key] = (_pick(mine, chain(before, edges.before(at, host) if first else ()), 2, []), [], [page])
            before.add(mine)
    yield from leave(True)


def _hashes(texts: Iterable[str]) -> tuple[int, ...]:
    return tuple(xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63) for t in texts)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The page's lines as hashes, pages without lines left out."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            some = batch.slice(at, 500)
            lines = pa.array([_hashes(t for _, t in lines_of(x or "")) for x in some.column("html").to_pylist()], pa.list_(pa.int64()))
            names = ["part", "host", "path", "page_id"]
            out = pa.RecordBatch.from_arrays([*(some.column(c) for c in names), lines], [*names, "lines"])
            yield out.filter(pa.array([len(x) > 0 for x in lines]))


def _edge_pages(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Hosts and files of the first and last pages of each range; the files hold line hashes."""
    schema = pa.schema([("part", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("one", pa.bool_()), ("files", pa.list_(pa.string()))])
    part = first = host = None
    head, before = [], _Before()

    def told() -> pa.RecordBatch:
        ends, files = (head, [*before]), []
        for some in (slice(0, EDGE), slice(EDGE, None)):
            near = tuple(e[some] for e in ends)
            if any(near):
                files.append(new_file(folder, ".edge"))
                write(files[-1], pickle.dumps(near))
        return pa.RecordBatch.from_pylist([{"part": part, "first": first, "last": host, "one": first == host, "files": files}], schema)

    for batch in batches:
        for k, h, lines in zip(*(batch.column(c).to_pylist() for c in ("part", "host", "lines")), strict=True):
            mine = tuple(lines)
            if k != part:
                if part is not None:
                    yield told()
                part, first, host, head, before = k, h, h, [], _Before()
            if h != host:
                host, before = h, _Before()
            if h == first and not (head and _holds(mine, head[-1])):
                head.append(mine)
            before.add(mine)
    if part is not None:
        yield told()


def _extract(batches: Iterator[pa.RecordBatch], edges: _Edges) -> Iterator[pa.RecordBatch]:
    """Pages in the order of host and path: parse each, pair it with the nearest pages before and after it."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                for page_id, url, host, part, source in zip(*(some.column(c).to_pylist() for c in ("page_id", "url", "host", "part", "html")), strict=True):
                    lines = lines_of(source or "")
                    mine = _hashes(t for _, t in lines)
                    yield part, host, mine, ((tuple(k for k, _ in lines),), mine, [t for _, t in lines], page_id, url)

    def told(done: list[tuple]) -> pa.RecordBatch:
        ids, urls, texts = zip(*done, strict=True)
        return pa.RecordBatch.from_pydict({"page_id": pa.array(ids, pa.int64()), "url": pa.array(urls, pa.string()), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    done = []
    for pages, near in with_neighbours(rows(), edges):
        (kinds,), mine, texts, *_ = pages[0]
        text = difference(kinds, texts, near, mine)
        for page in pages:
            done.append((*page[3:], text))
            if len(done) == 500:
                yield told(done)
                done = []
    if done:
        yield told(done)


#: Sampled keys for each range.
SAMPLED = 40


def _with_range(rows: DataFrame, order: list[str], ranges: int) -> DataFrame:
    """``part``: the range of each row by host, path and page_id, divided at sampled keys."""

    def key(host, path, page_id) -> tuple:
        return host, path, page_id is not None, page_id or 0

    n = rows.count()
    keys = sorted({key(*r) for r in rows.select(*order).sample(min(1.0, SAMPLED * ranges / max(n, 1)), seed=1).collect()})
    bounds = keys[:: max(1, len(keys) // ranges)][1:]

    @F.arrow_udf("int")
    def part(host: pa.Array, path: pa.Array, page_id: pa.Array) -> pa.Array:
        return pa.array([bisect_right(bounds, key(*x)) for x in zip(host.to_pylist(), path.to_pylist(), page_id.to_pylist(), strict=True)], pa.int32())

    return rows.withColumn("part", part(*order))


def extract(pages: DataFrame, ranges: int | None = None) -> DataFrame:
    """page_id, url, html -> page_id, url, text, n_chars.  ranges: about how many ranges the sorted pages are divided into."""
    spark = pages.sparkSession
    url = F.coalesce(F.col("url"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_extract(url, r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), path.alias("path"), "html")
    order = ["host", "path", "page_id"]
    rows = _with_range(rows, order, ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    hashed = materialise(rows.select("part", *order, "html").mapInArrow(_hashed, "part int, host string, path string, page_id long, lines array<long>"), "lines")
    ends = hashed.repartitionByRange("part").sortWithinPartitions("part", *order)
    folder = shared_dir(spark, "edges")
    # one row for each range: two hosts and the names of two files; the pages stay in the files
    ends = materialise(ends.mapInArrow(lambda batches: _edge_pages(batches, folder), "part int, first string, last string, one boolean, files array<string>"), "edge-files").collect()
    sent = spark.sparkContext.broadcast({r["part"]: r.asDict() for r in ends})
    near = rows.repartitionByRange("part").sortWithinPartitions("part", *order)
    return near.mapInArrow(lambda batches: _extract(batches, _Edges(sent.value)), "page_id long, url string, text string, n_chars long")


def op1_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
