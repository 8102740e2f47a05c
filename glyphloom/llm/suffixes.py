"""Repeated passages by depth-limited most-significant-digit passes over suffixes.

A suffix matters through its first `length` elements only (bytes or words). Instead of a row per
suffix, runs of neighbouring suffixes are sorted together. In every window of `length` elements the
smallest hashed gram of its first and of its last stretch mark a span; neighbouring windows with
the same span are a run. The passes, each a count of 64-bit digits over the corpus:

1. digit = the span. A run whose span is found once holds no repeated window and drops out.
2. digit = the whole extent of a run. Found twice, every window in it is repeated: settled.
3. digit = the window itself, only for runs whose span repeats with differing extents: the edges of
   repeated passages.

Equal windows have equal spans, so the groups of equal digits left at the end are exactly the
repeated windows. What a text loses is the union of its repeated windows. Digits are counted per block first, then per
bucket of their hash; a passage found in any share of the texts reaches its bucket once per block. Blocks are
stretches of the scan, bounded by bytes, and there are as many buckets as the input fills, up to the
shuffle partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from glyphloom.llm.common import (Substrings, back_rows, back_schema, block_count, bucket_rows, bucket_schema, byte_values, chunks, cogrouped, found, grouped, joined,
                                  owners, partitions, scan_blocks, texts_of, unpacked_block, words)

_PLACE = 28  # bits of a place in a chunk; the others order the grams
_SETTLED, _LISTED, _WINDOW = 1, 2, 4


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every stretch of `width` values."""
    n = len(x)
    y = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    y[:n] = x
    y = y.reshape(-1, width)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    behind = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


class _Runs:
    """The runs of windows of one chunk: first and last start, span digit, extent digit."""

    def __init__(self, values: np.ndarray, starts: np.ndarray, length: int):
        self.length = length
        self.lo = self.hi = np.zeros(0, np.int64)
        self.span = self.extent = np.zeros(0, np.uint64)
        gram = max(1, min(32, length // 6))
        width = max(1, length // 4)
        ahead = length - gram - width + 1
        size = np.diff(starts)
        long = size >= length
        if not long.any():
            return
        self.hash = Substrings(values)
        at = np.arange(len(values) - gram + 1)
        low = np.uint64((1 << _PLACE) - 1)
        least = (_sliding_min((self.hash(at, at + gram) & ~low) | at.astype(np.uint64), width) & low).astype(np.int64)
        step = np.zeros(len(values) + 2, np.int8)
        np.add.at(step, starts[:-1][long], 1)
        np.add.at(step, starts[1:][long] - length + 1, -1)
        a = np.flatnonzero(np.cumsum(step, dtype=np.int8)[: len(values)])
        p, q = least[a], least[a + ahead]
        cut = np.flatnonzero((np.diff(a) != 1) | (np.diff(p) != 0) | (np.diff(q) != 0)) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(a)]]) - 1
        self.lo, self.hi = a[first], a[last]
        self.span = self.hash(p[first], q[first] + gram)
        self.extent = self.hash(self.lo, self.hi + length)

    def windows(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, digit and span of every window of the given runs."""
        n = self.hi[runs] - self.lo[runs] + 1
        start = np.repeat(self.lo[runs] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return start, self.hash(start, start + self.length) if len(start) else np.zeros(0, np.uint64), np.repeat(self.span[runs], n)


def _elements(data: np.ndarray, starts: np.ndarray, unit: str):
    """Values, starts of texts among them, and the bytes at which each element begins and ends (None: the element is a byte)."""
    if unit == "bytes":
        return byte_values(data), starts, None, None
    values, first, end, of_text = words(data, starts, lower=False)
    return values, of_text, first, end


def repeated_passages(docs: DataFrame, length: int = 400, unit: str = "bytes", carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove every element covered by a passage of `length` elements that also starts anywhere else.

    unit: "bytes", or "words" (runs of bytes other than ASCII white space; a removed run reaches from
    its first word to the end of its last). Overlapping occurrences and those in the same text count;
    passages never cross texts; all are judged on the input. Null text counts as empty. Rows with
    equal or null doc_ids are texts of their own. Returns doc_id, the columns of `carry`, n_bytes,
    n_removed, n_spans, spans (array of start and end bytes) and kept (binary).
    """
    columns = ["doc_id", "text", *carry]
    # Buckets follow the input too: a block sends at most one row to each, and no bucket is larger than a block.
    n = min(partitions(docs.sparkSession), block_count(docs))
    blocks = scan_blocks(docs, columns)
    digits, answers = bucket_schema(2, "long"), back_schema(1, "long")

    def runs_of(t: pa.Table):
        for first, data, starts in chunks(texts_of(t)):
            values, at, begin, end = _elements(data, starts, unit)
            yield first, data, starts, begin, end, _Runs(values, at, length)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, payload in ((b, p) for batch in batches for b, p in zip(batch["block"].to_pylist(), batch["payload"])):
            every = [(r.extent, r.span) for *_, r in runs_of(unpacked_block(payload))]
            extent, span = (np.concatenate(x) for x in zip(*every)) if every else (np.zeros(0, np.uint64),) * 2
            extent, at, count = np.unique(extent, return_index=True, return_counts=True)
            if len(extent):
                yield bucket_rows(block, n, span[at], extent, count.astype("<u4"), wide=True)

    def extents(key: tuple, t: pa.Table) -> Iterator[pa.RecordBatch]:
        block, span, extent, count = owners(t), joined(t["key"], np.uint64), joined(t["c0"], np.uint64), joined(t["c1"], "<u4").astype(np.int64)
        order = np.lexsort((block, extent, span))
        block, span, extent, count = block[order], span[order], extent[order], count[order]
        new_span = np.concatenate([[True], span[1:] != span[:-1]])
        new_extent = new_span | np.concatenate([[True], extent[1:] != extent[:-1]])
        of_span, of_extent = np.cumsum(new_span) - 1, np.cumsum(new_extent) - 1
        settled = (np.bincount(of_extent, weights=count) >= 2)[of_extent]
        differing = (np.bincount(of_span, weights=new_extent) >= 2)[of_span]
        flag = np.where(settled, _SETTLED, 0) | np.where(differing & new_extent, _LISTED, 0)
        keep = flag > 0
        return back_rows(block[keep], extent[keep], flag[keep].astype(np.uint8))

    def flags_of(right: pa.Table, kind: int):
        """The sorted digits sent back and their flags, of runs or of windows."""
        if not right.num_rows:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint8)
        key, flag = joined(right["key"], np.uint64), joined(right["c0"], np.uint8)
        keep = (flag & kind) > 0
        key, flag = key[keep], flag[keep]
        order = np.argsort(key, kind="stable")
        return key[order], flag[order]

    def windows(key: tuple, left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
        known, flag = flags_of(right, _SETTLED | _LISTED)
        known = known[(flag & _LISTED) > 0]
        if not left.num_rows or not len(known):
            return
        digit, span, done = [], [], np.zeros(len(known), bool)
        for *_, r in runs_of(unpacked_block(left["payload"][0])):
            at, there = found(known, r.extent)
            runs = np.flatnonzero(there)
            at, once = np.unique(at[runs], return_index=True)
            runs = runs[once][~done[at]]  # each extent once in a block
            done[at] = True
            if len(runs):
                _, d, s = r.windows(runs)
                digit.append(d)
                span.append(s)
        if digit:
            both = np.unique(np.stack([np.concatenate(digit), np.concatenate(span)]), axis=1, return_counts=True)
            yield bucket_rows(left["block"][0].as_py(), n, both[0][0], both[0][1], both[1].astype("<u4"), wide=True)

    def repeated(key: tuple, t: pa.Table) -> Iterator[pa.RecordBatch]:
        block, digit, span, count = owners(t), joined(t["key"], np.uint64), joined(t["c0"], np.uint64), joined(t["c1"], "<u4").astype(np.int64)
        order = np.lexsort((span, digit))
        block, digit, span, count = block[order], digit[order], span[order], count[order]
        group = np.cumsum(np.concatenate([[0], (digit[1:] != digit[:-1]) | (span[1:] != span[:-1])]))
        keep = (np.bincount(group, weights=count) >= 2)[group]
        return back_rows(block[keep], digit[keep], np.full(keep.sum(), _WINDOW, np.uint8))

    out_schema = docs.select(*columns).drop("text").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long")
    out_schema = out_schema.add("spans", T.ArrayType(T.LongType())).add("kept", "binary")
    names = out_schema.fieldNames()

    def cut(key: tuple, left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
        if not left.num_rows:
            return
        runs_known, runs_flag = flags_of(right, _SETTLED | _LISTED)
        windows_known, _ = flags_of(right, _WINDOW)
        settled_known = runs_known[(runs_flag & _SETTLED) > 0]
        open_known = runs_known[runs_flag == _LISTED]
        t = unpacked_block(left["payload"][0])
        for first, data, starts, begin, end, r in runs_of(t):
            _, settled = found(settled_known, r.extent)
            lo, hi = r.lo[settled], r.hi[settled] + length
            edge = np.flatnonzero(found(open_known, r.extent)[1])
            if len(edge):
                start, digit, _ = r.windows(edge)
                start = start[found(windows_known, digit)[1]]
                lo, hi = np.concatenate([lo, start]), np.concatenate([hi, start + length])
            if begin is not None and len(lo):
                lo, hi = begin[lo], end[hi - 1]
            step = np.bincount(lo, minlength=len(data) + 1) - np.bincount(hi, minlength=len(data) + 1) if len(lo) else np.zeros(len(data) + 1, np.int64)
            gone = np.cumsum(step)[:-1] > 0
            count = len(starts) - 1
            part = t.slice(first, count)
            edges = np.zeros(len(data) + 1, bool)
            edges[starts] = True
            head = np.flatnonzero(gone & (edges[:-1] | ~np.concatenate([[False], gone[:-1]])))
            tail = np.flatnonzero(gone & (edges[1:] | ~np.concatenate([gone[1:], [False]]))) + 1
            of_head = np.searchsorted(head, starts)
            kept, spans_out = [], []
            for i in range(count):
                a, b = starts[i], starts[i + 1]
                h = slice(of_head[i], of_head[i + 1])
                kept.append(data[a:b][~gone[a:b]].tobytes() if of_head[i + 1] > of_head[i] else data[a:b].tobytes())
                spans_out.append(np.stack([head[h] - a, tail[h] - a], axis=1).ravel().tolist())
            removed = np.concatenate([[0], np.cumsum(gone)])[starts]
            out = [part[c].combine_chunks() for c in ["doc_id", *carry]]
            out += [pa.array(np.diff(starts), pa.int64()), pa.array(np.diff(removed), pa.int64()), pa.array(np.diff(of_head), pa.int64()), pa.array(spans_out, pa.list_(pa.int64())), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in out], names)

    back = blocks.mapInArrow(spans, digits).groupBy("bucket").applyInArrow(grouped(extents, answers), answers)
    listed = blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(cogrouped(windows, digits), digits)
    edges = listed.groupBy("bucket").applyInArrow(grouped(repeated, answers), answers)
    return blocks.groupBy("block").cogroup(back.union(edges).groupBy("block")).applyInArrow(cogrouped(cut, out_schema), out_schema)
