"""Main text of web pages: each page is compared with the pages nearest to it by URL path within its
host, and lines that they share are deleted; markup tells where main text may stand.

A page is a sequence of blocks of text. Markup puts a block into a part that never holds main text (a
menu, an advert, a form), into an ``article`` or ``main`` element, or into neither. The blocks of all
three kinds are aligned with those of the nearest page by a longest common subsequence. Outside of
``article`` and ``main``, a shared block is deleted. Inside, passages recur for other reasons too
(quotations, copies), so a block is deleted only if all of the up to four nearest pages share it, two
at least, and such blocks have less than half of the words.

Nearest pages are neighbours in the order of host and path. That order is over the different paths of
all hosts and numbered as a whole, so no host meets in one task, and a page's text depends neither
on partitions nor on how often a page is there: decisions are made once for each different content of a host.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, in_order, small_rows, stored
from .url_filter import host_of, path_of

#: Elements that start and end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead title tr ul".split()
)
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup; the last two hold text.
RAW = ("script", "style", "iframe", "xmp", "noembed", "noframes", "title", "textarea")
#: Elements that are never main text.
LEFT_OUT = frozenset("script style noscript template svg head title nav footer aside form iframe object canvas audio video button select textarea datalist dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of class and id names (split at anything but letters and digits) of such parts.
PART_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr newsletter subscribe "
    "subscription signup sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus share sharing social related "
    "popup modal login pagination pager masthead".split()
)
#: Those of them that name other things too (``market-share``, ``related-work``): within an article or main element they count only
#: in names that have nothing but such words and words of containers.
AMBIGUOUS = frozenset("ad ads promo promotion banner subscription menu footer comment comments share sharing social related login pager".split())
CONTAINERS = frozenset(
    "area article articles bar block box btn button buttons container content count footer form group header icon icons inline inner item items label left "
    "link links list outer panel post posts right row section slot space text title top bottom middle unit widget wrap wrapper zone".split()
)
#: Whole names of such parts, whose words may well name others.
PART_NAMES = frozenset(
    "header site-header page-header top-header global-header siteheader pageheader notice notices site-notice respond recommended recommendations widget overlay "
    "search search-box search-form searchbox searchform skip skip-link toolbar".split()
)
_CELLS = frozenset(("td", "th", "br"))
_MAIN = frozenset(("article", "main"))

#: Pages of the order that one task looks through, and how far it looks to either side.
TILE, AROUND = 4096, 2
#: Contents with blocks to delete up to which they are broadcast.
BROADCAST_CONTENTS = 200_000

_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"[\s/]*(?:(>)|(=?[^\s/>=]+|=)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?)")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}


def _words(value: str | None) -> set[str]:
    return set("".join(c if c.isalnum() else " " for c in (value or "").lower()).split())


def _names_part(words: set[str], inside: bool) -> bool:
    """Whether a class or id name of these words is that of a part; ``inside``: within an article or main element."""
    found = words & PART_WORDS
    return bool(found) and (not inside or bool(found - AMBIGUOUS) or all(w in PART_WORDS or w in CONTAINERS or w.isdigit() for w in words))


def _is_part(tag: str, attributes: list[tuple[str, str]], inside: bool) -> bool:
    if tag in LEFT_OUT or (tag == "header" and not inside):
        return True
    if tag in ("html", "body"):
        return False
    if tag in _MAIN:
        return tag == "article" and any(k in ("class", "id") and {"comment", "comments"} & _words(v) for k, v in attributes)
    for key, value in attributes:
        value = value.lower()
        if key in ("class", "id") and any(name in PART_NAMES or _names_part(_words(name), inside) for name in value.split()):
            return True
        if (key == "role" and value.strip() in ROLES) or key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True
        if key == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def _events(page: str) -> Iterator[tuple[str, str, list[tuple[str, str]]]]:
    """(kind, text or tag, attributes) in page order; kind: data, start or end. Any text is taken: what
    is not markup is data. Each look for an end is given up for good once it fails, so time is linear."""
    at, n, no_comment_end, unclosed = 0, len(page), False, set()
    last_end = page.rfind(">")
    while at < n:
        mark = page.find("<", at)
        if mark < 0 or mark > last_end:  # no tag is closed from here on
            yield "data", page[at:], []
            return
        if mark > at:
            yield "data", page[at:mark], []
        if page.startswith("<!--", mark):
            stop = -1
            if page.startswith((">", "->"), mark + 4):
                stop = page.find(">", mark + 4) + 1
            elif not no_comment_end:
                stop = page.find("-->", mark + 4)
                no_comment_end, stop = stop < 0, stop + 3 if stop >= 0 else -1
            at = stop if stop >= 0 else page.find(">", mark) + 1
            continue
        found = _TAG.match(page, mark)
        if not found:
            if page[mark + 1] in "!?/":
                at = page.find(">", mark) + 1
            else:
                yield "data", "<", []
                at = mark + 1
            continue
        tag, at, attributes = found.group(1).lower(), found.end(), []
        if page.startswith(">", at):
            at += 1
        else:
            while at < n:
                part = _ATTRIBUTE.match(page, at)
                if part is None:
                    at = n
                    break
                at = part.end()
                if part.group(1):
                    break
                value = part.group(3) or part.group(4) or part.group(5) or ""
                attributes.append((part.group(2).lower(), entities.unescape(value) if "&" in value else value))
        if page[mark + 1] == "/":
            yield "end", tag, []
            continue
        yield "start", tag, attributes
        if tag in _RAW_END and tag not in unclosed:
            close = _RAW_END[tag].search(page, at)
            if close is None:
                unclosed.add(tag)
                if tag in RAW[:2]:
                    return  # a script or style to the end
            else:
                if tag in RAW[-2:] and close.start() > at:
                    yield "data", page[at : close.start()], []
                at = close.start()


def blocks_of(page: str | None) -> list[tuple[str, str]]:
    """(text, kind) of each block of a page; kind: main (inside an article or main element), plain, or
    part (of a menu, an advert and so on). An element of such a part that is never closed ends before the next block."""
    events = list(_events(page or ""))
    end, closed = [len(events)] * len(events), [False] * len(events)
    open_, count = [], {}  # (tag, event) of the open elements, and how many of each name
    mains = [0]  # article and main elements before each event

    def close(upto: int, at: int, own: bool) -> None:
        while len(open_) > upto:
            tag, i = open_.pop()
            count[tag] -= 1
            end[i], closed[i] = at, own and len(open_) == upto

    for at, (kind, tag, _) in enumerate(events):
        mains.append(mains[-1] + (kind == "start" and tag in _MAIN))
        if kind == "start" and tag not in VOID:
            if tag in BLOCKS and count.get("p"):  # a block ends an open paragraph
                k = next(k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == "p" or open_[k][0] in BLOCKS)
                if open_[k][0] == "p":
                    close(k, at, False)
            open_.append((tag, at))
            count[tag] = count.get(tag, 0) + 1
        elif kind == "end" and count.get(tag):
            close(next(k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == tag), at, True)
    out: list[tuple[str, str]] = []
    text: list[str] = []
    left: list[str] = []  # text of the part; one that is no block of its own may stand within a block
    inside = part = -1  # the event that ends the outermost article or main element, and the part
    until_block = False  # the part ends before the next block

    def end_block(pieces: list[str], kind: str) -> None:
        joined = " ".join("".join(pieces).split())
        if joined:
            out.append((joined, kind))
        pieces.clear()

    for at, (kind, tag, attributes) in enumerate(events):
        if kind == "data":
            (left if at <= part else text).append(entities.unescape(tag) if "&" in tag else tag)
            continue
        if until_block and at < part and kind == "start" and tag in BLOCKS:
            part, until_block = at - 1, False
        if left and (at > part or tag in BLOCKS):
            end_block(left, "part")
        if at > part:
            if tag in BLOCKS:
                end_block(text, "main" if at <= inside else "plain")
            elif tag in _CELLS:
                text.append(" ")
        elif tag in _CELLS:
            left.append(" ")
        if kind == "end" or tag in VOID or at <= part:
            continue
        # a part by its name, or a form, that holds the article is none
        if _is_part(tag, attributes, at <= inside) and (tag in LEFT_OUT and tag != "form" or mains[end[at]] == mains[at + 1]):
            text.append(" ")
            part, until_block = end[at], not closed[at]
        elif tag in _MAIN and at > inside:
            inside = end[at]
    end_block(left, "part")
    end_block(text, "main" if len(events) <= inside else "plain")
    return out


def candidates(blocks: list[tuple[str, str]]) -> list[bool]:
    """Which blocks may be main text: those inside article and main, if there are none, the plain ones."""
    kind = "main" if any(k == "main" for _, k in blocks) else "plain"
    return [k == kind for _, k in blocks]


def _ends(a: list[int], b: list[int]) -> list[int]:
    """Longest common subsequence lengths of a with every beginning of b, by bit rows."""
    at: dict[int, int] = {}
    for j, y in enumerate(b):
        at[y] = at.get(y, 0) | 1 << j
    row, full = (1 << len(b)) - 1, (1 << len(b)) - 1
    for x in a:
        met = row & at.get(x, 0)
        row = ((row + met) | (row - met)) & full
    out, n = [0], 0
    for bit in reversed(bin(row)[2:].zfill(len(b)) if b else ""):
        n += bit == "0"
        out.append(n)
    return out


def common(a: list, b: list) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b``, in memory that grows with their
    lengths, not with the product: the halves of ``a`` go with the best cut of ``b``."""
    numbers: dict = {}
    a, b = ([numbers.setdefault(x, len(numbers)) for x in s] for s in (a, b))
    out: set[int] = set()
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.add(a0)
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            out.add(a1 - 1)
            a1, b1 = a1 - 1, b1 - 1
        if a0 == a1 or b0 == b1:
            continue
        if a1 - a0 == 1:
            if a[a0] in b[b0:b1]:
                out.add(a0)
            continue
        mid = (a0 + a1) // 2
        left, right = _ends(a[a0:mid], b[b0:b1]), _ends(a[mid:a1][::-1], b[b0:b1][::-1])
        cut = max(range(b1 - b0 + 1), key=lambda j: left[j] + right[b1 - b0 - j])
        todo += [(a0, mid, b0, b0 + cut), (mid, a1, b0 + cut, b1)]
    return out


def _same_start(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def shared(path: str, keys: list[int], may: list[bool], sizes: list[int], inside: bool, near: list[tuple[str, list[int]]]) -> list[int]:
    """Numbers (among the blocks that may be main text) of those to delete.

    keys, may, sizes: of all blocks, in order: identity, whether it may be main text, words. near: path
    and keys of other pages, the nearest in the order first. The nearest page is the one whose path begins
    with most of the same characters, of equal ones the first. If everything would go, nothing goes."""
    if not near or not any(may):
        return []
    own = set(keys)
    if inside:
        if len(near) < 2 or not all(own & set(k) for _, k in near):
            return []
        gone = set(range(len(keys)))
        for _, other in near:
            gone &= common(keys, other)
    else:
        nearest = max(near, key=lambda x: _same_start(x[0], path))
        gone = common(keys, nearest[1]) if own & set(nearest[1]) else set()
    mine = [i for i, m in enumerate(may) if m]
    out = [n for n, i in enumerate(mine) if i in gone]
    if inside and 2 * sum(sizes[mine[n]] for n in out) >= sum(sizes[i] for i in mine):
        return []
    return out if len(out) < len(mine) else []


_PARSED = T.StructType([
    T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("content", T.StringType()), T.StructField("inside", T.BooleanType()),
    T.StructField("texts", T.ArrayType(T.StringType())), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("may", T.ArrayType(T.BooleanType())), T.StructField("sizes", T.ArrayType(T.IntegerType())),
])


def _parsed(pages: DataFrame, url: str, html: str, name: str) -> DataFrame:
    """All columns of ``pages`` but ``html``, and a struct ``name`` of the page's blocks."""
    host, path = free_name([*pages.columns, name]), free_name([*pages.columns, name], "p")
    marked = pages.withColumns({host: host_of(url), path: path_of(url)})
    spot = pages.columns.index(html)
    rest = [c for c in pages.columns if c != html]
    kind = pa.struct([
        ("host", pa.string()), ("path", pa.string()), ("content", pa.string()), ("inside", pa.bool_()), ("texts", pa.list_(pa.string())), ("keys", pa.list_(pa.int64())), ("may", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                lists: tuple[list, ...] = ([], [], [], [], [], [])
                for page in part.column(spot).to_pylist():
                    blocks = blocks_of(page)
                    may = candidates(blocks)
                    digests = [xxhash.xxh64_intdigest(t.encode("utf-8", "replace")) for t, _ in blocks]
                    same = xxhash.xxh3_128_hexdigest(repr([(d, m, k == "main") for d, m, (_, k) in zip(digests, may, blocks, strict=True)]))
                    row = (
                        same, any(k == "main" for _, k in blocks), [t.encode("utf-8", "replace").decode() for (t, _), m in zip(blocks, may, strict=True) if m],
                        [d - (1 << 64) if d >> 63 else d for d in digests], may, [t.count(" ") + 1 for t, _ in blocks],
                    )
                    for into, x in zip(lists, row, strict=True):
                        into.append(x)
                arrays = [part.column(part.num_columns - 2).cast(pa.string()), part.column(part.num_columns - 1).cast(pa.string()), *[pa.array(x, f.type) for x, f in zip(lists, list(kind)[2:], strict=True)]]
                columns = [c for i, c in enumerate(part.columns[:-2]) if i != spot]
                yield pa.RecordBatch.from_arrays([*columns, pa.StructArray.from_arrays(arrays, fields=list(kind))], [*rest, name])

    return marked.mapInArrow(run, T.StructType([*[pages.schema[c] for c in rest], T.StructField(name, _PARSED)]))


def _nearest(contents: DataFrame) -> DataFrame:
    """host, path and near array<struct<path, keys>>: the pages around each path of a host in the order of
    paths, nearest first. A path with several contents is looked at by the one with the least hash."""
    paths = in_order(contents.groupBy("host", "path").agg(F.min_by("keys", "content").alias("keys")), ["host", "path"])
    tiles = [F.floor((F.col("rank") + k) / F.lit(TILE)) for k in (-AROUND, 0, AROUND)]
    dealt = paths.withColumn("tile", F.explode(F.array_distinct(F.array(*tiles))))
    along = Window.partitionBy("tile").orderBy("rank")
    page = F.struct("host", "path", "keys")
    around: list[Column] = [f(page, k).over(along) for k in range(1, AROUND + 1) for f in (F.lag, F.lead)]
    seen = dealt.withColumn("near", F.array(*around)).filter(F.col("tile") == F.floor(F.col("rank") / F.lit(TILE)))
    same_host = F.filter("near", lambda x: x.isNotNull() & (x["host"] == F.col("host")))
    return seen.select("host", "path", F.transform(same_host, lambda x: F.struct(x["path"].alias("path"), x["keys"].alias("keys"))).alias("near")).filter(F.size("near") > 0)


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each content with something to delete, which of its blocks that may be main text stay."""
    for batch in batches:
        rows = batch.to_pylist()
        found = [shared(r["path"], r["keys"], r["may"], r["sizes"], r["inside"], [(x["path"], x["keys"]) for x in r["near"]]) for r in rows]
        some = [i for i, f in enumerate(found) if f]
        stay = []
        for i in some:
            flags = np.ones(sum(rows[i]["may"]), bool)
            flags[found[i]] = False
            stay.append(flags)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some, pa.int64())), batch.column(1).take(pa.array(some, pa.int64())), pa.array(stay, pa.list_(pa.bool_()))], ["host", "content", "stay"])


def extract(pages: DataFrame, url: str = "url", html: str = "html", broadcast_contents: int = BROADCAST_CONTENTS) -> DataFrame:
    """All columns of ``pages`` but ``html``, and main_text string, main_chars long (code points), and
    main_deleted int (blocks that may have been main text and went as shared lines).

    Null or empty html, and a page without text: an empty text. Null URLs, and such without ``://``, have an
    empty host and path; pages of one path are not each other's neighbours, as they may well be one page.
    Neighbours at the same distance by path: the one before. Pages of one content on a host are treated alike, however many and
    wherever they are. Broken markup: any text gives blocks. Pages of any length are read whole, once. No
    rows: no rows. Columns of any names are carried; those with the added names are replaced."""
    base = pages.drop("main_text", "main_chars", "main_deleted")
    name = free_name(base.columns)
    parsed = stored(_parsed(base, url, html, name), compression="zstd")
    fields = ["host", "path", "content", "inside", "keys", "may", "sizes"]
    each = parsed.select(*[F.col(f"`{name}`.{f}").alias(f) for f in fields])
    contents = stored(each.groupBy("host", "content").agg(F.min("path").alias("path"), *[F.first(f).alias(f) for f in fields[3:]]))
    asked = contents.join(_nearest(contents), ["host", "path"]).select("host", "content", "path", "keys", "may", "sizes", "inside", "near")
    decided = stored(asked.mapInArrow(_decide, "host string, content string, stay array<boolean>"))
    keyed = small_rows(decided.select(F.struct("host", "content").alias("of"), "stay"), broadcast_contents)
    joined = parsed.join(keyed, F.struct(F.col(f"`{name}`.host"), F.col(f"`{name}`.content")) == keyed["of"], "left")
    texts, stay = F.col(f"`{name}`.texts"), keyed["stay"]
    left = F.when(stay.isNull(), texts).otherwise(F.filter(texts, lambda x, i: F.get(stay, i)))
    deleted = F.coalesce(F.size(F.filter(stay, lambda x: ~x)), F.lit(0))
    rest = [parsed[f"`{c}`"] for c in base.columns if c != html]
    out = joined.select(*rest, F.array_join(left, "\n").alias("main_text"), deleted.alias("main_deleted"))
    return out.withColumn("main_chars", F.length("main_text").cast("long")).select(*[f"`{c.name}`" for c in out.schema.fields[:-2]], "main_text", "main_chars", "main_deleted")
