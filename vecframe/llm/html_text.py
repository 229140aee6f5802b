"""Main text of web pages by differencing a page with the page of the nearest URL.

Pages are sorted by host and path, so that the nearest URL of a page whose lines differ stands beside its run of equal pages;
ranges are cut anywhere, and the pages at their ends are matched over the cuts. Both pages become lines of text with their
place in the markup; a longest common subsequence aligns the lines, and aligned lines are deleted as the site's frame. Where a
page marks its article, its lines are its own whatever the neighbour has (two pages may carry one article). Elements that are
no text of an article by themselves (nav, aside, form and so on, ARIA landmarks, and classes or ids made of nothing but words
for menus, adverts, comments and the like) go even if no neighbour shares their lines.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|textarea|title|xmp|noembed)\b[^>]*(?:/>|>(?:.*?</(?P=raw)\s*>|.*\Z)|\Z)|<(?P<tag>/?[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?>[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is not the article's; of them those that end where a block begins, if they are not closed before.
_FRAME = frozenset("nav header footer aside form button menu dialog head noscript template iframe object canvas audio video datalist svg math select".split())
_OPEN = frozenset("svg math select".split())
_BLOCKS = frozenset("address article aside blockquote body center div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog".split())
#: Words of class and id names: those of a frame, of which the second set stands for parts of an article inside one, and
#: those that say nothing. A name counts if it has a frame word and no other word: site-footer does, share-price does not.
_ADDED = frozenset(
    "ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments cookie cookies menu modal nav navbar navigation newsletter notice popup promo promotion related replies respond share sharing sidebar social sponsor sponsored subscribe widget widgets".split()
)
_AROUND = frozenset("banner footer header masthead search toolbar complementary contentinfo".split())
_PLAIN = frozenset("area bar block bottom box col column container content desktop global group inner item items left link links list main mobile outer page primary right row secondary section site slot sub thread top unit wrap wrapper zone".split())
_SPACE = re.compile(r"\s+")
MAIN, FRAME = 1, 2
#: Pages in a range of URLs: about so many, and on small tables at least so many.
RANGE_PAGES, LEAST_PAGES = 20_000, 200


def _named_frame(attrs: str, inside: bool) -> bool:
    """Whether class, id or role say that an element belongs to the frame; ``inside`` an article fewer names do."""
    for kind, *values in _NAMED.findall(attrs):
        for name in "".join(values).lower().split():
            if kind.lower() == "role":
                if name in _ROLES and not (inside and name == "banner"):
                    return True
                continue
            words = [w for w in re.split(r"[-_\d]+", name) if w]
            if any(w in _ADDED or (w in _AROUND and not inside) for w in words) and all(w in _ADDED or w in _AROUND or w in _PLAIN for w in words):
                return True
    return False


def lines_of(page: str) -> list[tuple[str, int]]:
    """The page's blocks of text in order, with MAIN inside an article or main element and FRAME inside the frame."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, int]] = []
    opened: Counter[str] = Counter()
    state, held, held_state = 0, [], 0

    def flush():
        if held:
            text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
            if text:
                out.append((text, held_state))
            held.clear()

    def close(tag: str) -> int:
        while True:
            name, before = stack.pop()
            opened[name] -= 1
            if name == tag:
                return before

    for m in _TOKEN.finditer(page):
        text = m["text"]
        if text is not None:
            if not held:
                held_state = state
            held.append(text)
            continue
        tag = m["tag"]
        if tag is None:
            if m["raw"]:
                held.append(" ")
            continue
        tag = tag.lower()
        if tag in _INLINE:
            if tag == "br":
                held.append(" ")
            if not m["attrs"] or "=" not in m["attrs"]:
                continue
        if tag.lstrip("/") not in _INLINE:
            flush()
        if tag[0] == "/":
            if opened[tag[1:]]:
                if tag[1:] in _INLINE:
                    flush()
                state = close(tag[1:])
            continue
        if tag in _VOID or m["attrs"].endswith("/"):
            continue
        if stack and (stack[-1][0] == tag and tag in ("p", "li", "td", "tr", "option", "dd", "dt") or stack[-1][0] == "p" and tag in _BLOCKS):
            state = close(stack[-1][0])
        if tag in _BLOCKS:
            for name in _OPEN:
                if opened[name]:
                    state = close(name)
        before = state
        if tag in ("article", "main"):
            state |= MAIN
        if tag in _FRAME:
            if not (tag == "header" and state & MAIN):
                state |= FRAME
        elif "=" in m["attrs"] and tag not in ("html", "body", "article", "main") and _named_frame(m["attrs"], bool(state & MAIN)):
            if tag in _INLINE:
                flush()
            state |= FRAME
        if tag in _INLINE and state == before:
            continue
        stack.append((tag, before))
        opened[tag] += 1
    flush()
    return out


def _rows_of_bits(own: list[int], places: list[list[int]], begin: int, end: int, row: int, full: int, held: dict[int, int]) -> list[int]:
    """Rows begin + 1 to end of the table of common subsequences, as bits that are 0 where a row's length grows."""
    out = []
    for line in own[begin:end]:
        match = held.get(line)
        if match is None:
            match = 0
            for p in places[line]:
                match |= 1 << p
            if len(places[line]) > 64:  # few lines have so many
                held[line] = match
        both = row & match
        row = ((row + both) | (row - both)) & full
        out.append(row)
    return out


def aligned(a: list[str], b: list[str]) -> set[int]:
    """Places in ``a`` of a longest common subsequence of lines.

    Common ends and lines of one side are set apart first. The table's rows are integers of one bit a line; every so many are
    kept and those between computed again on the way back, so memory is linear but for a square root.
    """
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    ea, eb = len(a), len(b)
    while ea > lo and eb > lo and a[ea - 1] == b[eb - 1]:
        ea, eb = ea - 1, eb - 1
    found = {*range(lo), *range(ea, len(a))}
    numbers = {line: k for k, line in enumerate(set(a[lo:ea]) & set(b[lo:eb]))}
    ia = [i for i in range(lo, ea) if a[i] in numbers]
    own = [numbers[a[i]] for i in ia]
    places: list[list[int]] = [[] for _ in numbers]
    width = 0
    for line in b[lo:eb]:
        if line in numbers:
            places[numbers[line]].append(width)
            width += 1
    full, step, held = (1 << width) - 1, math.isqrt(len(own)) + 1, {}
    marks = [full]
    for begin in range(0, len(own) - step, step):
        marks.append(_rows_of_bits(own, places, begin, begin + step, marks[-1], full, held)[-1])
    column = width
    for k in range(len(marks) - 1, -1, -1):
        if not column:
            break
        begin = k * step
        rows = [x.to_bytes(width // 8 + 1, "little") for x in (marks[k], *_rows_of_bits(own, places, begin, min(begin + step, len(own)), marks[k], full, held))]
        row = len(rows) - 1
        while row and column:
            at, bit = column - 1 >> 3, 1 << (column - 1 & 7)
            if rows[row][at] & bit:
                column -= 1
            else:
                row -= 1
                if rows[row][at] & bit:
                    found.add(ia[begin + row])
                    column -= 1
    return found


def main_text(lines: list[tuple[str, int]], neighbour: list[tuple[str, int]] | None) -> str:
    """Lines of the article; of a page that marks none, the lines outside the frame that the neighbour does not share."""
    marked = any(f & MAIN for _, f in lines)
    shared: set[int] = set()
    if neighbour and not marked:
        shared = aligned([t for t, _ in lines], [t for t, _ in neighbour])
        if len(shared) == len(lines):
            shared = set()  # one page under two addresses
    return "\n".join(t for i, (t, f) in enumerate(lines) if not f & FRAME and (f & MAIN if marked else i not in shared))


def _nearer(path: str, before: str | None, after: str | None) -> int:
    """Which neighbour shares the longer start of the path: 0 before, 1 after, -1 none."""
    shared = [-1 if p is None else next((i for i, (x, y) in enumerate(zip(path, p, strict=False)) if x != y), min(len(path), len(p))) for p in (before, after)]
    return -1 if max(shared) < 0 else int(shared[1] > shared[0])


_KEYS = "uid string, host string, path string, url string, page_id long, lines long, marked boolean"
_PLACED = "uid string, host string, path string, lines long, marked boolean, part long, p_uid string, p_path string, n_uid string, n_path string, head boolean, tail boolean, edge int"


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each page a number of its lines, and whether it marks its article."""
    for batch in batches:
        pages = [lines_of(x) for x in batch.column("html").to_pylist()]
        numbers = [int.from_bytes(hashlib.blake2b("\n".join(t for t, _ in x).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True) for x in pages]
        marked = [any(f & MAIN for _, f in x) for x in pages]
        columns = [*(batch.column(c) for c in ("uid", "host", "path", "url", "page_id")), pa.array(numbers, pa.int64()), pa.array(marked, pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, names=["uid", "host", "path", "url", "page_id", "lines", "marked"])


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page of a sorted range with the last page before its run of equal pages and the first after it, within the range.

    ``head`` and ``tail``: the run reaches the start or end of the range; ``edge`` 1 at its first page, 2 at its last, 3 at both.
    """
    part, out, before, run = TaskContext.get().partitionId(), [], None, []
    start = True

    def settle(after):
        nonlocal start
        for r in run:
            own = [x if x and x[1] == r[1] and r[1] is not None else (None,) * 3 for x in (before, after)]
            out.append([*r, part, own[0][0], own[0][2], own[1][0], own[1][2], before is None, after is None, 0])
        if start:
            out[0][-1] += 1
            start = False
        if after is None:
            out[-1][-1] += 2

    def flush():
        types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.int32()]
        names = [c.split()[0] for c in _PLACED.split(", ")]
        columns = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("uid", "host", "path", "lines", "marked")), strict=True):
            if run and (run[0][1], run[0][3]) != (row[1], row[3]):
                settle(row)
                before, run = run[-1], []
                if len(out) >= 1000:
                    yield flush()
            run.append(row)
    if run:
        settle(None)
        yield flush()


def _across(edges: list, last: int) -> dict[int, tuple]:
    """For each range the page (uid, host, path) that stands next to the run at one end of it, in another range.

    ``edges``: (first row, last row) by range in the order of the walk; ``last`` 0 walks up, 1 down.
    """
    found, held, beyond = {}, None, None
    reach, uid, path = (("head", "p_uid", "p_path"), ("tail", "n_uid", "n_path"))[last]
    for near, far in edges:
        same = held is not None and (held.host, held.lines) == (near.host, near.lines)
        found[near.part] = beyond if same or held is None else (held.uid, held.host, held.path)
        beyond = found[near.part] if far[reach] else None if far[uid] is None else (far[uid], far.host, far[path])
        held = far
    return found


def _choose(before: dict[int, tuple], after: dict[int, tuple]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = []
            for r in batch.to_pylist():
                sides = [(r["p_uid"], r["host"], r["p_path"]), (r["n_uid"], r["host"], r["n_path"])]
                for k, (end, other) in enumerate((("head", before), ("tail", after))):
                    if r[end]:
                        sides[k] = other[r["part"]]
                sides = [x if x and x[0] is not None and x[1] == r["host"] and r["host"] is not None else None for x in sides]
                k = _nearer(r["path"], *(x and x[2] for x in sides))
                if k >= 0:
                    pairs.append((r["uid"], sides[k][0]))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in pairs], pa.string()) for i in (0, 1)], names=["of", "near"])

    return run


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(lines_of(page), None if near is None else lines_of(near)) for page, near in zip(batch.column("html").to_pylist(), batch.column("near_html").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text (empty if none), n_chars.

    Whole pages are read; a null page is empty, a page with a null or odd URL has no neighbour, and a page whose lines all
    are its neighbour's too is left whole. Rows are known by a digest of id, URL and page, so equal rows give equal texts and
    no row number is needed; null ids are kept, other columns are ignored, an empty table gives no rows. Ranges and cuts do
    not change any text.
    """
    common.bounded_batches(pages.sparkSession)
    url = F.col(f"`{url_col}`").cast("string")
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"), url.alias("url"), F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1).alias("path"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"),
    )
    rows = rows.withColumn("host", F.when(F.col("host") != "", F.col("host"))).withColumn("path", F.coalesce("path", F.lit("")))
    rows = rows.withColumn("uid", F.md5(F.concat_ws("\n", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce(F.length("url"), F.lit(-1)), F.coalesce("url", F.lit("")), "html").cast("binary")))
    setting = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = common.materialize(rows.mapInArrow(_keys, _KEYS))
    n = keys.count()
    parts = max(1, min(max(setting, n // RANGE_PAGES), n // LEAST_PAGES))
    order = ("host", "path", "url", "page_id", "lines")
    placed = common.materialize(keys.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_place, _PLACED))
    ends: dict[int, list] = {}
    for r in placed.where("edge > 0").collect():  # two rows a range
        first, last = ends.setdefault(r.part, [None, None])
        ends[r.part] = [r if r.edge & 1 else first, r if r.edge & 2 else last]
    before = _across([tuple(ends[p]) for p in sorted(ends)], 0)
    after = _across([tuple(reversed(ends[p])) for p in sorted(ends, reverse=True)], 1)
    chosen = common.materialize(placed.where("not marked").mapInArrow(_choose(before, after), "of string, near string").distinct())
    common.discard(keys, placed)
    near = rows.select(F.col("uid").alias("near"), F.col("html").alias("near_html")).join(chosen, "near").dropDuplicates(["of"]).select("of", "near_html")
    both = rows.join(near, F.col("uid") == F.col("of"), "left").select("page_id", "url", "html", "near_html")
    return both.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
