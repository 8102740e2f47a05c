"""Images, binary colour frames and frame packs as Spark scans and columns.

The byte layouts are decoded inside tasks, one Arrow batch per frame, so a task
never holds more than one decoded frame next to its input batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.functions.exprs import idiv
from glyphloom.operators.ordering import spread_out
from glyphloom.schemas import CELLS_DDL, COLOR_FRAME_GLOB, FLAG_HAS_BACKGROUND, PACK_MAGIC, PACK_VERSION, PIXELS_DDL
from glyphloom.sources.segments import HEADER_BYTES, archive_header, hinted, part_cuts
from glyphloom.sources.text import folder_clip, with_frame_no


# ---------------------------------------------------------------- images
def scan_image_files(spark: SparkSession, path: str, glob: str = "*.{png,jpg,jpeg}") -> DataFrame:
    """Decoded images of a folder: clip_id, frame_no, path, width, height, channels, data (BGR rows).
    Undecodable files have width -1 (see ``image_rejects``)."""
    raw = spark.read.format("image").option("pathGlobFilter", glob).load(path).select("image.*")
    named = raw.withColumn("path", F.col("origin"))
    return with_frame_no(named).select(
        folder_clip(F.col("path")).alias("clip_id"), "frame_no", "path", "width", "height",
        F.col("nChannels").alias("channels"), "data",
    )


def image_rejects(images: DataFrame) -> DataFrame:
    """Files Spark could not decode."""
    return images.filter("width <= 0").select("clip_id", "frame_no", "path", F.lit("undecodable").alias("reject_reason"))


def image_pixels(images: DataFrame) -> DataFrame:
    """Pixels of decoded images: alpha is dropped, grey is replicated."""
    schema = pa.schema([("clip_id", pa.int64()), ("frame_no", pa.int64())] + [(c, pa.int32()) for c in "width height y x r g b".split()])

    def expand(batches):
        for batch in batches:
            for rec in batch.to_pylist():
                w, h, n = rec["width"], rec["height"], rec["channels"]
                px = np.frombuffer(rec["data"], np.uint8).reshape(h * w, n).astype(np.int32)
                b, g, r = (px[:, 0], px[:, 0], px[:, 0]) if n == 1 else (px[:, 0], px[:, 1], px[:, 2])
                spot = np.arange(h * w, dtype=np.int32)
                ids = [np.full(h * w, rec[k], np.int64) for k in ("clip_id", "frame_no")]
                size = [np.full(h * w, v, np.int32) for v in (w, h)]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in (*ids, *size, spot // w, spot % w, r, g, b)], schema=schema)

    usable = images.filter("width > 0").select("clip_id", "frame_no", "width", "height", "channels", "data")
    return usable.mapInArrow(expand, PIXELS_DDL)


def scan_images(spark: SparkSession, path: str, glob: str = "*.{png,jpg,jpeg}") -> DataFrame:
    """Folder of PNG / JPEG files to pixels."""
    return image_pixels(scan_image_files(spark, path, glob))


# ---------------------------------------------------------------- colour frames
def scan_binary_frames(spark: SparkSession, path: str, glob: str = COLOR_FRAME_GLOB) -> DataFrame:
    """Binary colour frames of a folder: clip_id, frame_no, raw, path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return with_frame_no(files).select(folder_clip(F.col("path")).alias("clip_id"), "frame_no", F.col("content").alias("raw"), "path")


def u32_at(raw: Column, start: int) -> Column:
    """Little-endian unsigned 32-bit value at a 1-based byte position."""
    low_first = [F.conv(F.hex(F.substring(raw, start + i, 1)), 16, 10).cast("bigint") * (256**i) for i in range(4)]
    return low_first[0] + low_first[1] + low_first[2] + low_first[3]


def frame_header(raw: Column) -> Column:
    """``struct(width, height, body_end, background_at)``: sizes from the header,
    ``background_at`` is the 0-based start of the background payload or null."""
    w, h = u32_at(raw, 1), u32_at(raw, 5)
    area = F.try_multiply(w, h)
    body_end = F.try_add(F.try_multiply(area, F.lit(4)), F.lit(8))
    extra, back = F.octet_length(raw) - body_end, F.try_multiply(area, F.lit(3))
    flag = F.conv(F.hex(F.substring(raw, F.try_add(body_end, F.lit(1)).try_cast("int"), F.lit(1))), 16, 10).cast("int")
    flagged = (extra > back) & (flag.bitwiseAND(FLAG_HAS_BACKGROUND) != 0)
    start = F.when(flagged, body_end + 1).when((extra == back) & (extra > 0), body_end)
    return F.struct(w.alias("width"), h.alias("height"), body_end.alias("body_end"), start.alias("background_at"))


def raw_reject_reason(raw: Column) -> Column:
    """First rule a binary colour frame breaks, or null."""
    head = frame_header(raw)
    size = F.octet_length(raw)
    return (
        F.when(raw.isNull(), F.lit("unreadable"))
        .when(size < 8, F.lit("too_small"))
        .when((head["width"] == 0) | (head["height"] == 0), F.lit("zero_dims"))
        .when(head["body_end"].isNull(), F.lit("dims_overflow"))
        .when(size < head["body_end"], F.lit("truncated"))
    )


def has_background(raw: Column) -> Column:
    """Background payload present, from header, length and one byte."""
    return frame_header(raw)["background_at"].isNotNull()


def decode_cell_frames(frames: DataFrame) -> DataFrame:
    """Binary colour frames (all three layouts) to cells. Run ``raw_reject_reason``
    first: rows it names would fail here and are skipped."""
    names = [f.split()[0] for f in CELLS_DDL.split(", ")]
    types = {"clip_id": pa.int64(), "frame_no": pa.int64(), "glyph": pa.string()}
    schema = pa.schema([(n, types.get(n, pa.int32())) for n in names])

    def expand(batches):
        for batch in batches:
            for rec in batch.to_pylist():
                w, h, at = rec["width"], rec["height"], rec["background_at"]
                n = w * h
                body = np.frombuffer(rec["raw"], np.uint8, n * 4, 8).reshape(n, 4)
                spot = np.arange(n, dtype=np.int32)
                glyphs = pa.array(list(body[:, 0].tobytes().decode("latin-1")), pa.string())
                fore = [pa.array(body[:, i].astype(np.int32)) for i in (1, 2, 3)]
                if at is None:
                    back = [pa.nulls(n, pa.int32())] * 3
                else:
                    rgb = np.frombuffer(rec["raw"], np.uint8, n * 3, at).reshape(n, 3).astype(np.int32)
                    back = [pa.array(rgb[:, i]) for i in range(3)]
                ids = [pa.array(np.full(n, rec[k], np.int64)) for k in ("clip_id", "frame_no")]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(spot // w), pa.array(spot % w), glyphs, *fore, *back], schema=schema)

    good = frames.filter(raw_reject_reason(F.col("raw")).isNull()).withColumn("_h", frame_header(F.col("raw")))
    return good.select("clip_id", "frame_no", "raw", "_h.width", "_h.height", "_h.background_at").mapInArrow(expand, CELLS_DDL)


def scan_cell_frames(spark: SparkSession, path: str) -> DataFrame:
    """Folder of binary colour frames to cells."""
    return decode_cell_frames(scan_binary_frames(spark, path))


def byte_of(value: Column) -> Column:
    """One byte as BINARY; null for a value that is none."""
    v = value.cast("bigint")
    return F.when(v.between(0, 255), F.unhex(F.lpad(F.hex(v), 2, "0")))


def u32_bytes(value: Column) -> Column:
    """Little-endian unsigned 32-bit BINARY."""
    v = value.cast("bigint")
    return F.concat(*[byte_of(idiv(v, 256**i) % 256) for i in range(4)])


def encode_cell_frames(cells: DataFrame) -> DataFrame:
    """Cells to one binary colour frame per (clip, frame): clip_id, frame_no, raw, reject_reason.

    ``raw`` is null and a reason is given when the grid has holes or doubles,
    a colour is missing, or a glyph is no single byte below 128.
    """
    cell = F.concat(byte_of(F.ascii("glyph")), byte_of(F.col("fr")), byte_of(F.col("fg")), byte_of(F.col("fb")))
    back = F.concat(byte_of(F.col("br")), byte_of(F.col("bg")), byte_of(F.col("bb")))
    plain = (F.octet_length("glyph") == 1)
    gathered = (
        cells.withColumn("_cell", cell).withColumn("_back", back)
        .groupBy("clip_id", "frame_no")
        .agg(
            (F.max("col") + 1).alias("w"), (F.max("row") + 1).alias("h"), F.count(F.lit(1)).alias("n"),
            F.count("_cell").alias("n_cell"), F.count("_back").alias("n_back"), F.bool_and(plain).alias("plain"),
            F.expr("listagg(_cell, X'') within group (order by row, col)").alias("body"),
            F.expr("listagg(_back, X'') within group (order by row, col)").alias("back"),
        )
    )
    want = F.col("w").cast("bigint") * F.col("h")
    reason = (
        F.when(~F.col("plain"), F.lit("non_ascii"))
        .when(F.col("n") < want, F.lit("too_few_cells"))
        .when(F.col("n") > want, F.lit("too_many_cells"))
        .when(F.col("n_cell") != want, F.lit("foreground_length"))
        .when((F.col("n_back") != 0) & (F.col("n_back") != want), F.lit("background_length"))
    )
    tail = F.when(F.col("n_back") > 0, F.concat(byte_of(F.lit(FLAG_HAS_BACKGROUND)), F.col("back"))).otherwise(F.unhex(F.lit("")))
    raw = F.concat(u32_bytes(F.col("w")), u32_bytes(F.col("h")), F.col("body"), tail)
    return gathered.select("clip_id", "frame_no", F.when(reason.isNull(), raw).alias("raw"), reason.alias("reject_reason"))


# ---------------------------------------------------------------- packs
PACK_ROW_BYTES = 2**31 - 2**20  # what one BINARY value can hold, with some room


PACKED_DDL = "clip_id bigint, part int, blob binary, reject_reason string"


def _archives(batches):
    """Task-side helper: entries of sorted frames -> whole archives, or a reject where one would not fit in a row."""
    def row(clip, part, held, n):
        blob, reason = (None, "too_large") if held is None else (b"".join([archive_header(n), *held]), None)
        return pa.RecordBatch.from_arrays(
            [pa.array([clip], pa.int64()), pa.array([part], pa.int32()), pa.array([blob], pa.binary()), pa.array([reason], pa.string())],
            [c.split()[0] for c in PACKED_DDL.split(", ")])

    key, held, n, size = None, [], 0, 0
    for batch in batches:
        for clip, part, raw in zip(batch["clip_id"].to_pylist(), batch["part"].to_pylist(), batch["raw"]):
            if (clip, part) != key:
                if key:
                    yield row(*key, held, n)
                key, held, n, size = (clip, part), [], 0, HEADER_BYTES
            raw = raw.as_py()
            n, size = n + 1, size + len(raw) + 4
            if size > PACK_ROW_BYTES:
                held = None
            if held is not None:
                held += [len(raw).to_bytes(4, "little"), raw]
    if key:
        yield row(*key, held, n)


def pack_frames(frames: DataFrame, part_bytes: int | None = None, block: int = 4096) -> DataFrame:
    """All frames of a clip, in order, as archives: clip_id, part, blob, reject_reason.

    Rejected frames (null ``raw``) are left out. A clip gives exactly one archive; one
    that no row can hold has a null ``blob`` and the reason ``too_large``. With
    ``part_bytes`` a clip is cut into several complete archives instead, so that no
    clip has to fit in one row or one task; where a part ends follows from the sizes
    alone. Payloads are exchanged once, by archive, and each is put together from
    sorted rows as they come. ``segments`` keeps archives of any size whole.
    """
    rows = frames.where("raw IS NOT NULL").select("clip_id", "frame_no", "raw")
    if part_bytes:
        # A part ends behind the frame that passes its bytes: with the largest frame that a row can hold it still has to fit into a row.
        entry = F.octet_length("raw").cast("bigint") + 4
        largest = rows.agg(F.max(F.when(entry + HEADER_BYTES <= PACK_ROW_BYTES, entry))).first()[0] or 0
        cuts = hinted(part_cuts(rows, max(1, min(part_bytes, PACK_ROW_BYTES - HEADER_BYTES - largest + 1)), block))
        passed = F.filter("cuts", lambda c: c["first"] <= F.col("frame_no"))
        rows = rows.withColumn("_block", idiv(F.col("frame_no"), block)).join(cuts, ["clip_id", "_block"]).select(
            "clip_id", F.array_max(F.transform(passed, lambda c: c["part"])).alias("part"), "frame_no", "raw")
    else:
        rows = rows.select("clip_id", F.lit(0).alias("part"), "frame_no", "raw")
    keys = ["clip_id", "part"]
    return spread_out(rows, *keys).sortWithinPartitions(*keys, "frame_no").mapInArrow(_archives, PACKED_DDL)


UNPACKED_DDL = "clip_id bigint, part int, frame_no bigint, raw binary, reject_reason string"


def unpack_frames(packs: DataFrame) -> DataFrame:
    """Archives to one row per frame, bytes preserved; ``frame_no`` counts from 1
    inside the archive. A broken archive gives one row with ``reject_reason``:
    too_small, bad_magic, bad_version, no_frames, truncated_length,
    truncated_payload, trailing_bytes."""
    schema = pa.schema([("clip_id", pa.int64()), ("part", pa.int32()), ("frame_no", pa.int64()), ("raw", pa.binary()), ("reject_reason", pa.string())])

    def spans(blob):
        if blob is None or len(blob) < 12:
            return None, "too_small"
        if blob[:4] != PACK_MAGIC:
            return None, "bad_magic"
        version, count = (int(v) for v in np.frombuffer(blob, "<u4", 2, 4))
        if version != PACK_VERSION:
            return None, "bad_version"
        if count == 0:
            return None, "no_frames"
        at, found = 12, []
        while len(found) < count:
            if at + 4 > len(blob):
                return None, "truncated_length"
            size = int.from_bytes(blob[at:at + 4], "little")
            if at + 4 + size > len(blob):
                return None, "truncated_payload"
            found.append((at + 4, at + 4 + size))
            at += 4 + size
        return (found, None) if at == len(blob) else (None, "trailing_bytes")

    def row(rec, number, raw, reason):
        return pa.RecordBatch.from_arrays(
            [pa.array([rec["clip_id"]], pa.int64()), pa.array([rec["part"]], pa.int32()), pa.array([number], pa.int64()),
             pa.array([raw], pa.binary()), pa.array([reason], pa.string())], schema=schema)

    def expand(batches):
        for batch in batches:
            for rec in batch.to_pylist():
                found, reason = spans(rec["blob"])
                if reason:
                    yield row(rec, None, None, reason)
                for number, (a, b) in enumerate(found or (), 1):
                    yield row(rec, number, rec["blob"][a:b], None)

    part = F.col("part") if "part" in packs.columns else F.lit(0)
    return packs.select("clip_id", part.alias("part"), "blob").mapInArrow(expand, UNPACKED_DDL)
