"""Main text of web pages: block lines, structure, and differencing against the page with the nearest URL.

A page is read once into lines (one per block); scripts, styles and markup are no lines. Tags, roles and whole
class names mark menus, footers and other surroundings, never an element that holds all articles of its page. The lines
of every page are aligned with those of the page nearest by URL path on its host, by longest common
subsequence over 64-bit line hashes, and shared lines are deleted as the host's template: all of them on a page without article or main
element; in an article those in blocks with a doubtful class name, and those that stand outside the article, in no marked block, on the other page.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from os.path import commonprefix
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.llm.common import arrow_schema, checkpointed, partitions

# Elements and names by their meaning.
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "svg", "math", "object", "canvas", "title", "xmp", "noembed", "noframes"}
DROPPED = {"head", "nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "br"}
HINTS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "popup", "modal", "newsletter", "subscribe", "share", "sharing", "social", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "comment", "comments", "disqus", "respond", "related", "widget", "pagination", "pager"}
OUTER_HINTS = {"header", "masthead", "banner", "topbar"}
PLACES = {"area", "bar", "block", "bottom", "box", "button", "buttons", "container", "form", "global", "group", "inline", "inner", "item", "left", "link", "links", "list", "outer", "page", "post", "posts", "right", "section", "signup", "site", "slot", "top", "unit", "wrap", "wrapper"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alertdialog"}

_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_WORD = re.compile(r"[a-z0-9]+")
_SPACE = re.compile(r"\s+")

#: What a line is: in an article, there in a doubtful block, outside of all articles, in marked surroundings.
TEXT, DOUBTFUL, OUTSIDE, SURROUNDING = range(4)
#: Paragraphs from which on a form is a page, not a form.
FORM_PARAGRAPHS = 3
#: Places to delete that every task may hold, four bytes each.
HELD_PLACES = 2_000_000
#: Bits of alignment rows held at a time.
ALIGN_BITS = 1 << 28


def _tag_end(page: str, at: int) -> int:
    """Just after the tag that begins at `at`; quoted values may hold >."""
    end = page.find(">", at)
    if end < 0:
        return len(page)
    piece = page[at:end]
    if "=" not in piece or (piece.count('"') % 2 == 0 and piece.count("'") % 2 == 0):
        return end + 1
    quote, k = "", at
    while k < len(page):
        c = page[k]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'" and page[at:k].rstrip().endswith("="):
            quote = c
        elif c == ">":
            return k + 1
        k += 1
    return end + 1


def _mark(name: str, tag: str, inside: bool) -> int | None:
    """SURROUNDING for menus and the like, DOUBTFUL for a class name that only contains such a word, else None.

    A name counts whole: every word of it says surroundings or a place (share-buttons, but not has-share-buttons).
    """
    if name in DROPPED or name == "header" and not inside:
        return SURROUNDING
    if "=" not in tag or name in ("html", "body", "article", "main"):
        return None
    hints, mark = HINTS if inside else HINTS | OUTER_HINTS, None
    for key, *values in _ATTRIBUTE.findall(tag):
        key, value = key.lower(), "".join(values).lower()
        if key == "role" and value.strip() in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return SURROUNDING
        if key in ("class", "id"):
            for words in map(_WORD.findall, value.split()):
                if hints.intersection(words):
                    if hints.issuperset(w for w in words if w not in PLACES):
                        return SURROUNDING
                    mark = DOUBTFUL
    return mark


def _tags(page: str, lower: str) -> Iterator[tuple[int, int, str, bool, bool]]:
    """(start, end, name, closing, closed in itself) of all tags; comments, raw elements and stray < have other names: !, #, <."""
    at, size = 0, len(page)
    while (start := page.find("<", at)) >= 0:
        nxt = page[start + 1 : start + 2]
        if nxt == "!" or nxt == "?":
            comment = page.startswith("<!--", start)
            end = page.find("-->" if comment else ">", start + (4 if comment else 1))
            at = size if end < 0 else end + (3 if comment else 1)
            yield start, at, "!", False, True
            continue
        closing = nxt == "/"
        m = _NAME.match(lower, start + 1 + closing)
        if not m:
            at = start + 1
            yield start, at, "<", False, True
            continue
        name, at = m[0], _tag_end(page, start)
        alone = page.endswith("/>", start, at)
        if not closing and name in RAW:
            if not alone:
                stop = lower.find("</" + name, at)
                at = size if stop < 0 else _tag_end(page, stop)
            name = "#"
        yield start, at, name, closing, alone


def _holders(tags: list[tuple[int, int, str, bool, bool]]) -> set[int]:
    """Starts of the elements that hold all articles and mains of a page, and of forms that hold a page's text."""
    stack: list[tuple[int, str]] = []
    open_names: dict[str, int] = {}
    common: list[tuple[int, str]] | None = None
    low, pages, forms = 0, set(), []
    for start, _, name, closing, alone in tags:
        if closing:
            if open_names.get(name):
                while True:
                    gone = stack.pop()[1]
                    open_names[gone] -= 1
                    if gone == "form":
                        forms.pop()
                    if gone == name:
                        break
                low = min(low, len(stack))
            continue
        if name in VOID or name in INLINE or alone:
            continue
        if name in ("article", "main") and not open_names.get("article") and not open_names.get("main"):
            common = list(stack) if common is None else common[:low]
            low = len(stack)
        if forms and name in ("h1", "p"):
            forms[-1][1] += FORM_PARAGRAPHS if name == "h1" else 1
            if forms[-1][1] >= FORM_PARAGRAPHS:
                pages.add(forms[-1][0])
        if name == "form":
            forms.append([start, 0])
        stack.append((start, name))
        open_names[name] = open_names.get(name, 0) + 1
    return pages | {start for start, _ in common or ()}


def lines(page: str) -> tuple[list[str], list[int]]:
    """Lines of a page in order, and what each is. Linear in the page."""
    lower = page.lower() if page.isascii() else "".join(c.lower() if c < "\x80" else c for c in page)
    tags = list(_tags(page, lower))
    holders = _holders(tags)
    out: list[str] = []
    kinds: list[int] = []
    held: list[str] = []
    marked: list[list] = [["", 0], ["", 0]]  # the open doubtful and surrounding element, and its depth
    inside, at = 0, 0

    def flush():
        if held:
            text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
            held.clear()
            if text:
                out.append(text)
                kinds.append(SURROUNDING if marked[1][1] else OUTSIDE if not inside else DOUBTFUL if marked[0][1] else TEXT)

    for start, end, name, closing, alone in tags:
        if start > at:
            held.append(page[at:start])
        at = end
        if name == "<":
            held.append("<")
        if name in "!#<":
            continue
        if name not in INLINE:
            flush()
        elif name == "br":
            held.append(" ")
        ended = False
        for m in marked:
            if m[1] and name == m[0] and name not in VOID and not (alone and not closing):
                if closing and m[1] == 1:
                    flush()
                    ended = True
                m[1] += -1 if closing else 1
        if marked[1][1] or ended and closing:
            continue
        if name in ("article", "main"):
            inside = max(0, inside + (-1 if closing else 1))
        elif not closing and name not in VOID and not alone and start not in holders:
            mark = _mark(name, page[start:end], inside > 0)
            if mark is not None and not marked[mark == SURROUNDING][1]:
                flush()
                marked[mark == SURROUNDING][:] = name, 1
    if at < len(page):
        held.append(page[at:])
    flush()
    return out, kinds


def _rows(a: list, b: list) -> Iterator[int]:
    """Bit rows of the lengths of longest common subsequences of b's and a's beginnings: a zero bit is a step."""
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    yield row
    for x in a:
        u = row & where.get(x, 0)
        row = ((row + u) | (row - u)) & full
        yield row


def _lengths(a: list, b: list) -> np.ndarray:
    """Length of the longest common subsequence of a with every beginning of b."""
    for row in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def shared_lines(a: list, b: list) -> dict[int, int]:
    """Places of `a` in a longest common subsequence with `b`, and their places in `b`.

    Only lines of both take part. Where all rows would be over ALIGN_BITS, `a` is halved and `b` cut where both halves fit best.
    """
    both = set(a) & set(b)
    at, bt = ([k for k, x in enumerate(s) if x in both] for s in (a, b))
    out: dict[int, int] = {}
    parts = [(0, len(at), 0, len(bt))]
    while parts:
        i0, i1, j0, j1 = parts.pop()
        while i0 < i1 and j0 < j1 and a[at[i0]] == b[bt[j0]]:
            out[at[i0]] = bt[j0]
            i0, j0 = i0 + 1, j0 + 1
        if i0 == i1 or j0 == j1:
            continue
        x, y = [a[k] for k in at[i0:i1]], [b[k] for k in bt[j0:j1]]
        if len(x) > 1 and len(x) * len(y) > ALIGN_BITS:
            h = len(x) // 2
            cut = int((_lengths(x[:h], y) + _lengths(x[h:][::-1], y[::-1])[::-1]).argmax())
            parts += [(i0, i0 + h, j0, j0 + cut), (i0 + h, i1, j0 + cut, j1)]
            continue
        rows, j = list(_rows(x, y)), len(y)

        def length(r, j):
            return j - (r & ((1 << j) - 1)).bit_count()

        # A step of the lengths at j that the row before lacks is a shared line.
        for i in range(len(x), 0, -1):
            while j and length(rows[i], j) == length(rows[i], j - 1):
                j -= 1
            if not j:
                break
            if length(rows[i - 1], j) < length(rows[i], j):
                out[at[i0 + i - 1]] = bt[j0 + j - 1]
                j -= 1
    return out


def template_lines(hashes: list[int], kinds: list[int], near: list[int], near_kinds: list[int]) -> list[int]:
    """Places of the lines of a page that the page near it shows to be template (see the module)."""
    article, near_article = min(kinds, default=OUTSIDE) < OUTSIDE, min(near_kinds, default=OUTSIDE) < OUTSIDE
    gone = []
    for i, j in shared_lines(hashes, near).items():
        loose = near_article and near_kinds[j] == OUTSIDE
        if kinds[i] == (DOUBTFUL if article else OUTSIDE) or kinds[i] == TEXT and loose:
            gone.append(i)
    return sorted(gone)


def _neighbours(keys: DataFrame) -> DataFrame:
    """(row, other) of every wanted row of keys (row, host, path, url, page_id, wanted, digest): the row nearest by URL path on its host, null where there is none.

    Rows are range-partitioned in the order of their URLs, so a host of any size is spread over tasks; a row
    looks at the last row before and the first one after it that have other lines (another digest). Of these a
    partition may lack the one before its first lines and the one after its last: each gives two rows at either end,
    a bounded table, from which they are found.
    """
    order = ["host", "path", F.coalesce("url", F.lit("")), "page_id", "digest", "row"]
    ordered = keys.repartitionByRange(partitions(keys.sparkSession), *order).sortWithinPartitions(*order)
    ordered = checkpointed(ordered.select(F.spark_partition_id().alias("part"), "row", "host", "path", "wanted", "digest"))

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first row, the first of another host or other lines, and the same from the end (which says last)."""
        first: list[dict] = []
        last: list[dict] = []
        for b in batches:
            for r in b.to_pylist():
                new = not last or (r["host"], r["digest"]) != (last[-1]["host"], last[-1]["digest"])
                if new and len(first) < 2:
                    first.append(r)
                last = [*last[-1:], r] if new else [*last[:-1], r]
        for kind, rows in (("first", first), ("last", last[::-1])):
            for k, r in enumerate(rows):
                yield pa.RecordBatch.from_pylist([{"part": r["part"], "kind": kind, "place": k, **{c: r[c] for c in ("row", "host", "path", "digest")}}], border)

    schema = "part int, kind string, place int, row long, host string, path string, digest string"
    border = arrow_schema(schema)
    ends: dict[tuple[int, str], list] = {}
    for r in sorted(ordered.mapInArrow(borders, schema).collect(), key=lambda r: r["place"]):  # four rows a partition
        ends.setdefault((r["part"], r["kind"]), []).append(r)
    parts = sorted({p for p, _ in ends})

    def beyond(own, others: list[int], far: str) -> tuple[int, str] | None:
        for q in others:
            for r in ends[q, far]:
                if (r["host"], r["digest"]) != (own["host"], own["digest"]):
                    return (r["row"], r["path"]) if r["host"] == own["host"] else None
        return None

    carried = {}
    for i, p in enumerate(parts):
        carried[p] = beyond(ends[p, "first"][0], parts[:i][::-1], "last"), beyond(ends[p, "last"][0], parts[i + 1 :], "first")

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        if not rows:
            return
        before, after = carried[rows[0]["part"]]
        out: list[list] = [[], []]
        starts = [i for i in range(len(rows)) if not i or any(rows[i][c] != rows[i - 1][c] for c in ("host", "digest"))]
        for i, j in zip(starts, [*starts[1:], len(rows)]):
            host = rows[i]["host"]
            left = before if not i else (rows[i - 1]["row"], rows[i - 1]["path"]) if rows[i - 1]["host"] == host else None
            right = after if j == len(rows) else (rows[j]["row"], rows[j]["path"]) if rows[j]["host"] == host else None
            near = [x for x in (left, right) if x]
            for r in rows[i:j]:
                if r["wanted"]:
                    out[0].append(r["row"])
                    out[1].append(max(near, key=lambda o: len(commonprefix([o[1], r["path"]])))[0] if near else None)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], ["row", "other"])

    return ordered.mapInArrow(nearest, "row long, other long")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html).

    Null html and pages without text give an empty text; a null or malformed url is a host of its own kind (""). Rows stay row by
    row. A page with lines in an article or main element has these as its text, another one the lines that no mark takes out,
    each without the template that the nearest page shows. A page that is alone on its host loses nothing to differencing,
    and neighbours of the same lines (copies of the page) are passed over. Lines meet as hashes; texts stay where they are while
    the places to delete, counted first, are few enough for each task to hold.
    """
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[], [], [], [], []]
            for url, page in zip(b["url"].to_pylist(), b["html"].to_pylist()):
                try:
                    u = urlsplit(url or "")
                    host, path = (u.hostname or "").removeprefix("www."), u.path
                except ValueError:
                    host, path = "", ""
                texts, kinds = lines(page or "")
                wanted = (TEXT, DOUBTFUL) if min(kinds, default=OUTSIDE) < OUTSIDE else (OUTSIDE,)
                hashes = [int.from_bytes(hashlib.blake2b(t.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True) for t in texts]
                for c, v in zip(rows, (host, path, [t if k in wanted else None for t, k in zip(texts, kinds)], hashes, bytes(kinds))):
                    c.append(v)
            columns = [pa.array(rows[0], pa.string()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.list_(pa.string())), pa.array(rows[3], pa.list_(pa.int64())), pa.array(rows[4], pa.binary())]
            yield pa.RecordBatch.from_arrays([b["row"], b["page_id"], b["url"], *columns], ["row", "page_id", "url", "host", "path", "lines", "hashes", "kinds"])

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = (b[k].to_pylist() for k in ("row", "hashes", "kinds", "near", "near_kinds"))
            gone = [(row, g) for row, *page in zip(*c) if (g := template_lines(*page))]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in gone], pa.int64()), pa.array([g for _, g in gone], pa.list_(pa.int32()))], ["row", "gone"])

    numbered = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long"), "url", "html")
    schema = "row long, page_id long, url string, host string, path string, lines array<string>, hashes array<long>, kinds binary"
    parsed = checkpointed(numbered.mapInArrow(parse, schema))  # read five times below; rows keep their numbers
    pairs = _neighbours(parsed.select("row", "host", "path", "url", "page_id", F.lit(True).alias("wanted"), F.md5(F.array_join("hashes", ",")).alias("digest")))
    shapes = parsed.select("row", "hashes", "kinds")
    met = shapes.join(pairs.where("other IS NOT NULL"), "row").join(shapes.toDF("other", "near", "near_kinds"), "other")
    gone = checkpointed(met.select("row", "hashes", "kinds", "near", "near_kinds").mapInArrow(differ, "row long, gone array<int>"))
    places = gone.agg(F.sum(F.size("gone") + 4)).first()[0] or 0
    found = parsed.select("row", "page_id", "url", "lines").join(F.broadcast(gone) if places <= HELD_PLACES else gone.hint("merge"), "row", "left")
    stays = F.filter("lines", lambda x, k: x.isNotNull() & ~F.coalesce(F.array_contains("gone", k), F.lit(False)))
    return found.select("page_id", "url", F.array_join(stays, "\n").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
