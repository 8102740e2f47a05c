import struct
import zlib

import pytest
from pyspark.sql import functions as F

from glyphloom.plans.conversion import convert_images, image_to_text
from glyphloom.schemas import CELLS_DDL
from glyphloom.sources import binary


def png(width, height, pixels, channels=3):
    """A PNG file from a function (x, y) -> channel bytes."""
    kind = {1: 0, 3: 2, 4: 6}[channels]
    raw = b"".join(b"\0" + b"".join(bytes(pixels(x, y)) for x in range(width)) for y in range(height))

    def chunk(tag, data):
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_scan_images(spark, tmp_path):
    (tmp_path / "frame_0001.png").write_bytes(png(3, 2, lambda x, y: (10 * x, 20 * y, 200)))
    (tmp_path / "frame_0002.png").write_bytes(png(2, 1, lambda x, y: (7 + x,), 1))
    (tmp_path / "frame_0003.png").write_bytes(png(1, 1, lambda x, y: (1, 2, 3, 99), 4))
    (tmp_path / "frame_0004.png").write_bytes(b"no image")
    images = binary.scan_image_files(spark, str(tmp_path))
    got = {(r.frame_no, r.y, r.x): (r.r, r.g, r.b) for r in binary.image_pixels(images).collect()}
    assert got[1, 1, 2] == (20, 20, 200) and got[1, 0, 1] == (10, 0, 200)
    assert got[2, 0, 1] == (8, 8, 8) and got[3, 0, 0] == (1, 2, 3)
    assert [r.frame_no for r in binary.image_rejects(images).collect()] == [4]


def test_scan_jpeg(spark, tmp_path):
    jvm = spark.sparkContext._jvm
    canvas = jvm.java.awt.image.BufferedImage(8, 8, 1)
    for y in range(8):
        for x in range(8):
            canvas.setRGB(x, y, (200 << 16) + (100 << 8) + 50)
    for name in ("frame_0001.jpg", "frame_0002.jpeg"):
        jvm.javax.imageio.ImageIO.write(canvas, "jpg", jvm.java.io.File(str(tmp_path / name)))
    got = binary.scan_images(spark, str(tmp_path)).collect()
    assert {r.frame_no for r in got} == {1, 2} and len(got) == 128
    assert all(abs(r.r - 200) < 6 and abs(r.g - 100) < 6 and abs(r.b - 50) < 6 for r in got)


def test_convert_images_dedups(spark, tmp_path):
    red, green = png(8, 8, lambda x, y: (255, 0, 0)), png(8, 8, lambda x, y: (0, 255, 0))
    for i, data in enumerate([red, green, red, red], 1):
        (tmp_path / f"frame_{i:04}.png").write_bytes(data)
    images = binary.scan_image_files(spark, str(tmp_path))
    cells = convert_images(images, columns=4, font_ratio=0.5)
    first = {r.frame_no: (r.n, r.c) for r in cells.groupBy("frame_no").agg(F.count("*").alias("n"), F.first(F.struct("fr", "fg", "fb")).alias("c")).collect()}
    assert {k: v[0] for k, v in first.items()} == {1: 8, 2: 8, 3: 8, 4: 8}
    assert tuple(first[4][1]) == (255, 0, 0) and tuple(first[2][1]) == (0, 255, 0)


def test_gradient_keeps_size(spark, tmp_path):
    (tmp_path / "frame_1.png").write_bytes(png(16, 16, lambda x, y: (x * 255 // 16,) * 3))
    row = image_to_text(binary.scan_images(spark, str(tmp_path)), columns=None, font_ratio=1.0).first()
    assert (row.width, row.height) == (16, 16)
    lines = row.text.split("\n")
    assert len(lines) == 17 and len(set(lines[:16])) == 1 and lines[0].startswith("  ")


def frame_bytes(w, h, body, tail=b""):
    return struct.pack("<II", w, h) + body + tail


BODY = bytes([65, 1, 2, 3, 66, 4, 5, 6])
BACK = bytes([7, 8, 9, 10, 11, 12])


def raws(spark, items):
    return spark.createDataFrame([(1, i, d) for i, d in enumerate(items)], "clip_id bigint, frame_no bigint, raw binary")


def test_three_layouts(spark):
    df = raws(spark, [frame_bytes(2, 1, BODY), frame_bytes(2, 1, BODY, b"\x01" + BACK), frame_bytes(2, 1, BODY, BACK), frame_bytes(2, 1, BODY, b"\x00" + BACK)])
    got = {(r.frame_no, r.col): (r.glyph, r.fr, r.fg, r.fb, r.br, r.bg, r.bb) for r in binary.decode_cell_frames(df).collect()}
    assert got[0, 1] == ("B", 4, 5, 6, None, None, None)
    assert got[1, 1] == got[2, 1] == ("B", 4, 5, 6, 10, 11, 12)
    assert got[3, 0] == ("A", 1, 2, 3, None, None, None)
    flags = {r.frame_no: r.b for r in df.select("frame_no", binary.has_background(F.col("raw")).alias("b")).collect()}
    assert flags == {0: False, 1: True, 2: True, 3: False}


def test_raw_rejects(spark):
    df = raws(spark, [b"abc", frame_bytes(0, 0, b""), frame_bytes(2, 2, BODY), None, frame_bytes(2, 1, BODY)])
    got = {r.frame_no: r.why for r in df.select("frame_no", binary.raw_reject_reason(F.col("raw")).alias("why")).collect()}
    assert got == {0: "too_small", 1: "zero_dims", 2: "truncated", 3: "unreadable", 4: None}
    assert binary.decode_cell_frames(df).count() == 2


def test_encode(spark):
    cells = spark.createDataFrame([(1, 1, 0, 0, "A", 1, 2, 3, 7, 8, 9), (1, 1, 0, 1, "B", 4, 5, 6, 10, 11, 12)], CELLS_DDL)
    raw = bytes(binary.encode_cell_frames(cells).first().raw)
    assert len(raw) == 23 and raw[16] == 1 and raw == frame_bytes(2, 1, BODY, b"\x01" + BACK)
    assert sorted(map(tuple, binary.decode_cell_frames(binary.encode_cell_frames(cells)).collect())) == sorted(map(tuple, cells.collect()))
    holes = spark.createDataFrame([(1, 1, 0, 0, "A", 1, 2, 3, None, None, None), (1, 1, 1, 1, "A", 1, 2, 3, None, None, None)], CELLS_DDL)
    assert binary.encode_cell_frames(holes).first().reject_reason == "too_few_cells"
    odd = spark.createDataFrame([(1, 1, 0, 0, "é", 1, 2, 3, None, None, None)], CELLS_DDL)
    assert binary.encode_cell_frames(odd).first().reject_reason == "non_ascii"
    half = spark.createDataFrame([(1, 1, 0, 0, "A", 1, 2, 3, 1, 1, 1), (1, 1, 0, 1, "A", 1, 2, 3, None, None, None)], CELLS_DDL)
    assert binary.encode_cell_frames(half).first().reject_reason == "background_length"


def test_pack_round_trip(spark):
    df = spark.createDataFrame([(1, 2, b"second"), (1, 1, b"first!!"), (2, 5, b"x")], "clip_id bigint, frame_no bigint, raw binary")
    packs = binary.pack_frames(df)
    blob = {r.clip_id: bytes(r.blob) for r in packs.collect()}
    assert blob[1] == b"CFPK" + struct.pack("<III", 1, 2, 7) + b"first!!" + struct.pack("<I", 6) + b"second"
    got = sorted((r.clip_id, r.frame_no, bytes(r.raw)) for r in binary.unpack_frames(packs).collect())
    assert got == [(1, 1, b"first!!"), (1, 2, b"second"), (2, 1, b"x")]
    parts = binary.pack_frames(spark.range(200).select(F.lit(1).cast("bigint").alias("clip_id"), F.col("id").alias("frame_no"), F.lit(b"12345678").alias("raw")), part_bytes=100, block=7)
    assert parts.count() == 24
    assert binary.unpack_frames(parts).count() == 200


@pytest.mark.parametrize("blob,why", [
    (b"CFPK", "too_small"), (b"XXXX" + struct.pack("<II", 1, 1), "bad_magic"), (b"CFPK" + struct.pack("<II", 2, 1), "bad_version"),
    (b"CFPK" + struct.pack("<II", 1, 0), "no_frames"), (b"CFPK" + struct.pack("<II", 1, 1) + b"\1", "truncated_length"),
    (b"CFPK" + struct.pack("<III", 1, 1, 9) + b"abc", "truncated_payload"), (b"CFPK" + struct.pack("<III", 1, 1, 1) + b"abc", "trailing_bytes")])
def test_pack_errors(spark, blob, why):
    df = spark.createDataFrame([(1, blob)], "clip_id bigint, blob binary")
    assert [r.reject_reason for r in binary.unpack_frames(df).collect()] == [why]
