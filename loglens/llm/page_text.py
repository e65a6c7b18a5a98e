"""Main text of web pages by differencing pages with near URLs.

Pages are laid out by host and path, so pages of a template stand side by side; a frequent host is cut into many ranges,
and each range gets the last pages before and the first ones behind it from its neighbours, so where it is cut
doesn't matter. Each page is read into lines, one per block of markup, and compared with the nearest pages of its host
that have another text. A longest common subsequence aligns their lines; what the page shares with most of them is the
template's and is deleted. Markup has a say as well: menus, forms, scripts and the like are no lines at all, and where a
page marks its article, lines elsewhere are dropped and its own are deleted only at its two ends, and only if all of at
least SEVERAL near pages have them: headings and quotes that articles share stay. Pages of equal text are copies,
which aren't compared.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape
from itertools import takewhile, zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import as_batch

# Fixed values of HTML: elements without content, with raw text, that stand in lines of their own, and that aren't text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
DROPPED = frozenset(
    "script style head title nav header footer aside form noscript template iframe object svg math canvas audio video button select option textarea dialog menu noembed noframes xmp".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of a class or id that tell of something other than the article.
WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu submenu
    breadcrumb breadcrumbs header masthead footer sidebar aside widget widgets cookie cookies consent gdpr notice notices alert popup modal overlay
    comment comments disqus replies respond share sharing social follow newsletter subscribe subscription signup login related recommended
    recommendations pagination pager toolbar skip search hidden""".split()
)
MAIN = frozenset(("article", "main"))
SILENT = frozenset(("script", "style", "template", "noscript"))  # they don't end the line around them
#: Classes and ids that tell the same inside an article, as whole tokens; anchors are made of a heading's words there.
INSIDE = frozenset(
    """ad ads advert advertisement adsbygoogle sponsored promo breadcrumb breadcrumbs pagination sidebar widget cookie-notice cookie-banner newsletter
    newsletter-signup related-posts related-articles share-buttons social-share sharing comments user-comments""".split()
)
ANCHORED = frozenset("h1 h2 h3 h4 h5 h6 p section".split())
#: Pages of another text that a page is compared with, among so many on each side; near pages that delete lines of an article.
NEAR, LOOK, SEVERAL = 4, 4, 3

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"(?:^|[\s\"'])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
#: Tags that end an open element of the same kind.
SIBLINGS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


def _other(tag: str, attributes: str, inside: bool = False) -> bool:
    """Whether an element is no part of an article; inside one, its class and id count as whole tokens only."""
    if tag in DROPPED:
        return True
    if attributes and tag not in ("html", "body"):
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return True
            if name == "role" and value in ROLES:
                return True
            if name in ("class", "id"):
                if inside and (tag in ANCHORED or INSIDE.isdisjoint(value.split())):
                    continue
                if inside or not WORDS.isdisjoint(re.split(r"[^a-z]+", value)):
                    return True
    return False


def lines(html: str) -> list[tuple[str, int]]:
    """Blocks of text in their order, decoded and with single spaces, and where they stand: 0 elsewhere, 1 main, 2 article."""
    out: list[tuple[str, int]] = []
    text: list[str] = []
    stack: list[tuple[str, bool]] = []
    skip, zone = 0, [0, 0, 0]

    def flush() -> None:
        if text:
            line = " ".join(unescape("".join(text)).split())
            if line:
                out.append((line, 2 if zone[2] else 1 if zone[1] else 0))
            text.clear()

    def close(to: int) -> None:
        nonlocal skip
        while len(stack) > to:
            tag, other = stack.pop()
            skip -= other
            if tag in MAIN and not other:
                zone[2 if tag == "article" else 1] -= 1

    at, size = 0, len(html)
    while at < size:
        m = TOKEN.search(html, at)
        if not skip:
            text.append(html[at : m.start() if m else size])
        if not m:
            break
        at = m.end()
        ends, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag not in INLINE and tag not in SILENT:
            if tag == "br":
                if not skip:
                    text.append(" ")
                continue
            if not skip:
                flush()
        if ends:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if not skip and tag not in INLINE:
                        flush()
                    close(i)
                    break
                if stack[i][0] in MAIN and tag not in ("body", "html", *MAIN):
                    break  # a stray end doesn't leave the article
            continue
        if tag in VOID or attributes.endswith("/") and tag not in RAW:
            continue
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in SIBLINGS.get(tag, ()):
                close(i)
                break
            if stack[i][0] not in INLINE:
                break
        other = _other(tag, attributes, zone[1] + zone[2] > 0)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else size
            continue
        stack.append((tag, other))
        skip += other
        if tag in MAIN and not other:
            zone[2 if tag == "article" else 1] += 1
    flush()
    return out


def common(a: list[str], b: list[str]) -> list[int]:
    """Places in a of a longest common subsequence of a and b, by rows of bits."""
    where: dict[str, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, rows = full, []
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if not i or rows[i - 1] >> (j - 1) & 1:
            out.append(i)
            j -= 1
    return out[::-1]


def main_text(own: list[tuple[str, int]], near: list[list[tuple[str, int]]] | None) -> tuple[str, int]:
    """The text that a page's lines leave beside those of near pages, and how many lines were deleted as shared."""
    best = max((z for _, z in own), default=0)
    times = [0] * len(own)
    for other in near or ():
        for i in common([x for x, _ in own], [x for x, _ in other]):
            times[i] += 1
    n = len(near or ())
    shared = {i for i, (_, z) in enumerate(own) if z == 0 and 2 * times[i] > n}
    inside = [i for i, (_, z) in enumerate(own) if z == best > 0]
    for side in (inside, inside[::-1]):
        shared.update(takewhile(lambda i: times[i] == n >= SEVERAL, side))
    kept = [x for i, (x, z) in enumerate(own) if z == best and i not in shared]
    return "\n".join(kept), len(shared)


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1), F.lit(""))


def _near(page: tuple, before: list[tuple], behind: list[tuple]) -> list[list]:
    """Lines of the NEAR nearest pages of the same host with texts other than the page's, from both sides by turns."""
    out: list[list] = []
    for x in (x for pair in zip_longest(behind, before) for x in pair):
        if x is not None and x[0] == page[0] and x[1] != page[1] and x[1] not in out and len(out) < NEAR:
            out.append(x[1])
    return out


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages in the order of range, host and path; each is compared while the near ones are at hand.

    Pages that only show a range what lies next to it give no row.
    """
    before: list[tuple] = []
    waiting: list[tuple] = []  # copies side by side as one: host, lines, html, ids and urls; until LOOK of them follow
    done: list[tuple] = []
    part = None

    def finish() -> None:
        page = waiting.pop(0)
        if page[3]:
            text, n = main_text(page[1], _near(page, before[::-1], waiting))
            done.extend((page_id, url, text, n) for page_id, url in page[3])
        before.append(page)
        del before[:-LOOK]

    def ready(kinds: tuple) -> pa.RecordBatch:
        own = done[:500]
        out = as_batch(
            {
                "page_id": pa.array([d[0] for d in own], kinds[0]),
                "url": pa.array([d[1] for d in own], kinds[1]),
                "text": pa.array([d[2] for d in own], pa.string()),
                "n_chars": pa.array(np.array([len(d[2]) for d in own], np.int64)),
                "n_shared": pa.array(np.array([d[3] for d in own], np.int64)),
            }
        )
        del done[:500]
        return out

    kinds: tuple | None = None
    for batch in batches:
        kinds = (batch.column("page_id").type, batch.column("url").type)
        columns = [batch.column(c) for c in ("_part", "_own", "_host", "page_id", "url", "html")]
        for i in range(batch.num_rows):
            now, mine, host, page_id, url, html = (c[i].as_py() for c in columns)
            if now != part:
                while waiting:
                    finish()
                before.clear()
                part = now
            if waiting and waiting[-1][0] == host and waiting[-1][2] == html:
                waiting[-1][3].extend([(page_id, url)] if mine else [])
                continue
            waiting.append((host, lines(html or ""), html, [(page_id, url)] if mine else []))
            if len(waiting) > LOOK + 1:  # the last one's copies may still follow
                finish()
            while len(done) >= 500:
                yield ready(kinds)
    while waiting:
        finish()
        while len(done) >= 500:
            yield ready(kinds)
    if done:
        yield ready(kinds)


#: How pages are ordered: by host and path, equal ones by a hash of all there is; keys sampled for a range, ranges of a task.
ORDER = ["_host", "_path", "_hash"]
SAMPLED, RANGES = 10, 16


def _part_of(bounds: list[tuple]) -> Column:
    """The number of the range that a page lies in."""

    @F.arrow_udf("int")
    def part(hosts: pa.Array, paths: pa.Array, hashes: pa.Array) -> pa.Array:
        rows = zip(hosts.to_pylist(), paths.to_pylist(), hashes.to_pylist())
        return pa.array([bisect_right(bounds, (h.encode(), p.encode(), x)) for h, p, x in rows], pa.int32())

    return part(*ORDER)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys in order: the first and the last LOOK + 1 pages of each range, copies side by side as one."""
    first: list[tuple] = []
    last: list[tuple] = []
    part, out = None, []

    def close() -> None:
        out.extend((part, False, *k) for k in first)
        out.extend((part, True, *k) for k in last)
        first.clear()
        last.clear()

    for batch in batches:
        for now, *key in zip(*(c.to_pylist() for c in batch.columns)):
            if now != part:
                close()
                part = now
            if last and last[-1][0] == key[0] and last[-1][3] == key[3]:
                continue
            last.append(tuple(key))
            del last[: -LOOK - 1]
            if len(first) <= LOOK:
                first.append(tuple(key))
    close()
    names = ["_part", "_last", *ORDER, "_page"]
    types = [pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    yield as_batch({n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate(zip(names, types))})


def _context(ends: list) -> list[tuple]:
    """(range, page key) of pages that a range needs from others: the nearest of the host at its edge, copies as one."""
    by_part: dict[int, tuple[list, list]] = {}
    for r in ends:
        by_part.setdefault(r["_part"], ([], []))[r["_last"]].append((r["_host"], r["_path"], r["_hash"], r["_page"]))
    parts, out = sorted(by_part), []
    for own, (first, last) in by_part.items():
        for others, host, side in ((parts[: parts.index(own)][::-1], first[0][0], True), (parts[parts.index(own) + 1 :], last[-1][0], False)):
            found: list[tuple] = []
            for p in others:
                keys = by_part[p][side]
                for k in keys[::-1] if side else keys:
                    if k[0] == host and len(found) <= LOOK and not (found and found[-1][3] == k[3]):
                        found.append(k)
                if len(found) > LOOK or keys[0 if side else -1][0] != host:
                    break
            out += [(own, *k[:3]) for k in found]
    return out


def page_text(pages: DataFrame, ranges: int | None = None) -> DataFrame:
    """(page_id, url, text, n_chars, n_shared) of every row; n_shared lines were deleted by comparison.

    Null and empty pages have an empty text; pages without a URL are neighbours of each other. Pages of equal text
    are copies, which aren't compared. The result doesn't depend on the number of ranges. Repeated rows get the same text;
    null ids stay null; a very long page is one page of its range. Other columns are ignored, also those named like results.
    """
    spark = pages.sparkSession
    ranges = ranges or RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    inner = pages.select("page_id", "url", "html").withColumns({"_host": host_of(F.col("url")), "_path": path_of(F.col("url"))})
    inner = inner.withColumns({"_hash": F.xxhash64(F.col("page_id").cast("string"), "url", "html"), "_page": F.xxhash64("html")})
    # A sample of as many keys as there are ranges, times SAMPLED, says where to cut.
    n = inner.count()
    some = inner.where(F.rand(1) < min(1.0, SAMPLED * ranges / max(n, 1))).select(*ORDER).collect()
    keys = sorted((r["_host"].encode(), r["_path"].encode(), r["_hash"]) for r in some)
    bounds = sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)} if keys else ())
    dealt = inner.withColumn("_part", _part_of(bounds))
    sent = dealt.select("_part", *ORDER, "_page").repartition("_part").sortWithinPartitions("_part", *ORDER)
    ends = sent.mapInArrow(_ends, "_part int, _last boolean, _host string, _path string, _hash long, _page long").collect()  # a few of each range
    context = spark.createDataFrame(_context(ends), "_to int, _host string, _path string, _hash long")
    shown = inner.join(F.broadcast(context), ORDER).dropDuplicates(["_to", *ORDER]).withColumn("_part", F.col("_to"))
    columns = ["_part", "_own", *ORDER, "page_id", "url", "html"]
    every = dealt.withColumn("_own", F.lit(True)).select(*columns).unionByName(shown.withColumn("_own", F.lit(False)).select(*columns))
    # Only what is read travels, and once: it is parsed where it arrives.
    placed = every.repartition("_part").sortWithinPartitions("_part", *ORDER, "_own")
    kinds = {f.name: f.dataType.simpleString() for f in inner.schema}
    return placed.mapInArrow(_extracted, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long, n_shared long")
