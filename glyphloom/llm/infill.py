"""Fill-in-middle: texts cut at two code points by a learned rank index, and put in another order.

The boundaries of all code points of a batch of texts are one ascending sequence of byte offsets. A
piecewise-linear model predicts the offset of a boundary from its rank: a segment grows for as long as
one line through its first point stays within ERROR bytes of every boundary. What the line misses is
stored, one byte a boundary, so that a predicted cut is corrected exactly and no text is walked.
Everything is local to a row: there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes that a prediction may be off; what is stored fits into one signed byte.
ERROR = 120
#: Bytes whose boundaries are fitted at a time.
STRETCH = 1 << 20
#: The marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")

OUTPUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def segments(offset: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """(first, end, slope): the line through the first offset stays within ERROR of all offsets up to end.

    Every offset narrows the cone of slopes that are still possible; the segment ends where none is.
    """
    first, n = 0, len(offset)
    while first < n:
        low, high, end, look = 1.0, 4.0, first + 1, 256
        while end < n:
            to = min(end + look, n)
            run, rise = np.arange(end - first, to - first), offset[end:to] - offset[first]
            lows = np.maximum(np.maximum.accumulate((rise - ERROR) / run), low)
            highs = np.minimum(np.minimum.accumulate((rise + ERROR) / run), high)
            empty = lows > highs
            fits = int(empty.argmax()) if empty.any() else to - end
            if fits:
                low, high = float(lows[fits - 1]), float(highs[fits - 1])
            end += fits
            if end < to:
                break
            look *= 2
        yield first, end, (low + high) / 2
        first = end


class RankIndex:
    """Byte offsets of the code points of UTF-8 data by rank: segments and the residuals of their lines."""

    def __init__(self, data: np.ndarray):
        rank, base, slope, residual, known = [], [], [], [], 0
        for at in range(0, len(data) + 1, STRETCH):
            part = data[at : at + STRETCH]
            offset = at + np.flatnonzero((part & 0xC0) != 0x80)
            if at + STRETCH > len(data):
                offset = np.append(offset, len(data))  # the end is a boundary too
            for first, end, s in segments(offset):
                rank.append(known + first)
                base.append(int(offset[first]))
                slope.append(s)
                residual.append((offset[first:end] - self._line(base[-1], s, np.arange(end - first))).astype(np.int8))
            known += len(offset)
        self.rank, self.base, self.slope = np.array(rank, np.int64), np.array(base, np.int64), np.array(slope)
        self.residual = np.concatenate(residual)

    @staticmethod
    def _line(base, slope, steps):
        return base + np.floor(slope * steps).astype(np.int64)

    def __call__(self, rank: np.ndarray) -> np.ndarray:
        """The exact offsets of these boundaries."""
        s = np.searchsorted(self.rank, rank, "right") - 1
        return self._line(self.base[s], self.slope[s], rank - self.rank[s]) + self.residual[rank]

    def ranks(self, offset: np.ndarray) -> np.ndarray:
        """The ranks of boundaries given by offset: the inverse, found by bisecting predictions."""
        low, high = np.zeros(len(offset), np.int64), np.full(len(offset), len(self.residual) - 1, np.int64)
        while (low < high).any():
            mid = (low + high) // 2
            over = self(mid) < offset
            low, high = np.where(over, mid + 1, low), np.where(over, high, mid)
        return low


def joined_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and where each starts with a last end. Null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    starts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[starts[0] : starts[-1]], starts - starts[0]


def _draw(seed: int, k: int) -> Column:
    """The k-th 32-bit number drawn for a document, from the hash of the seed and its id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def transform(docs: DataFrame, seed: int = 1, share: int = 90, suffix_first: int = 20) -> DataFrame:
    """Every text cut into prefix, middle and suffix: doc_id, n, form, prefix_chars, middle_chars, output.

    Cuts are code points drawn by seed and doc_id. `share` percent of the texts are transformed,
    `suffix_first` percent of them with the suffix in front (spm), the others with the prefix in front
    (psm). Empty and null texts, and those that hold one of MARKS, stay as they are (plain; null counts
    as empty). Rows of one doc_id, or without, are drawn alike (an absent id as an empty one) and kept row
    by row; columns beyond doc_id and text are ignored, whatever their names.
    """
    text = F.coalesce("text", F.lit(""))
    marked = F.contains(text, F.lit(MARKS[0])) | F.contains(text, F.lit(MARKS[1])) | F.contains(text, F.lit(MARKS[2]))
    plain = (text == "") | marked | (_draw(seed, 3) % 100 >= share)
    form = F.when(plain, "plain").when(_draw(seed, 4) % 100 < suffix_first, "spm").otherwise("psm")
    drawn = docs.select(F.col("doc_id").cast("long"), text.alias("text"), form.alias("form"), _draw(seed, 1).alias("a"), _draw(seed, 2).alias("b"))
    p, s, m = (x.encode() for x in MARKS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = joined_bytes(batch["text"])
            index = RankIndex(data)
            first = index.ranks(starts)
            n = np.diff(first)
            one, two = (batch[c].to_numpy() % (n + 1) for c in "ab")
            head, tail = np.minimum(one, two), np.maximum(one, two)
            x, y = index(first[:-1] + head), index(first[:-1] + tail)
            forms, raw, out = batch["form"].to_pylist(), memoryview(data), []
            for f, i, j, k, e in zip(forms, starts[:-1].tolist(), x.tolist(), y.tolist(), starts[1:].tolist()):
                parts = {"plain": (raw[i:e],), "psm": (p, raw[i:j], s, raw[k:e], m, raw[j:k]), "spm": (s, raw[k:e], p, raw[i:j], m, raw[j:k])}[f]
                out.append(b"".join(parts))
            untouched = np.array([f == "plain" for f in forms], bool)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n, pa.int64()), batch["form"], pa.array(head, pa.int64(), mask=untouched), pa.array(tail - head, pa.int64(), mask=untouched),
                 pa.array(out, pa.binary()).cast(pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return drawn.mapInArrow(cut, OUTPUT)


def restore(transformed: DataFrame) -> DataFrame:
    """The input with `restored`: the text, from output and form alone.

    A transformed text holds none of MARKS, and no mark can begin inside a part and end inside a
    mark, so each mark is found where it was put.
    """
    def between(a: str, b: str | None) -> Column:
        before = F.substring_index("output", b, 1) if b else F.col("output")
        return F.substring_index(before, a, -1)

    p, s, m = MARKS
    whole = F.when(F.col("form") == "psm", F.concat(between(p, s), between(m, None), between(s, m)))
    whole = whole.when(F.col("form") == "spm", F.concat(between(p, m), between(m, None), between(s, p)))
    return transformed.withColumn("restored", whole.otherwise(F.col("output")))


def digests(transformed: DataFrame) -> DataFrame:
    """The transformed rows with hashes of the output and of the restored text instead of the texts."""
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return restore(transformed).select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output").alias("output_sha256"), sha("restored").alias("restored_sha256"))
