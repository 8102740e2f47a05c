import random
import struct

import pytest
from pyspark.sql import functions as F

from glyphloom.sources import binary, segments

RAW = "clip_id bigint, frame_no bigint, raw binary"


def clips(spark, seed=1, n=300):
    rng = random.Random(seed)
    rows = [(rng.choice([1, 1, 1, 2, 3]), i * rng.choice([1, 1, 7]), bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 9, 40])))) for i in range(n)]
    rows = list({(c, i): (c, i, raw) for c, i, raw in rows}.values())
    rows += [(4, 1, None), (5, 2**40, b"one"), (1, 10**9, None)]
    return rows, spark.createDataFrame(rows, RAW).repartition(5)


def archives(rows):
    out = {}
    for c, _, raw in sorted(r for r in rows if r[2] is not None):
        out.setdefault(c, []).append(struct.pack("<I", len(raw)) + raw)
    return {c: b"CFPK" + struct.pack("<II", 1, len(e)) + b"".join(e) for c, e in out.items()}


@pytest.mark.parametrize("limit", [1, 30, 500, 1 << 20])
def test_segments_make_up_the_archives(spark, tmp_path, limit):
    rows, df = clips(spark)
    manifest = {(r.clip_id, r.first_frame_no): r for r in segments.write_segments(df, str(tmp_path), limit).collect()}
    held = spark.read.parquet(f"{tmp_path}/segments").collect()
    want = archives(rows)
    assert len(manifest) == len(held)
    for s in held:
        m = manifest[s.clip_id, s.first_frame_no]
        assert want[s.clip_id][m.byte_offset:m.byte_offset + m.bytes] == bytes(s.body) and m.bytes == s.bytes == len(s.body)
        assert s.n_frames == 1 or s.bytes <= limit
    for clip, whole in want.items():
        own = sorted((s.first_frame_no, bytes(s.body)) for s in held if s.clip_id == clip)
        assert segments.archive_header(sum(s.n_frames for s in held if s.clip_id == clip)) + b"".join(b for _, b in own) == whole
        assert sorted(m.segment for k, m in manifest.items() if k[0] == clip) == list(range(len(own)))
    got = sorted((r.clip_id, r.frame_no, bytes(r.raw), r.reject_reason) for r in segments.read_segments(spark, str(tmp_path)).collect())
    counted = [(c, k + 1, raw, None) for c in want for k, raw in enumerate(x[2] for x in sorted(r for r in rows if r[0] == c and r[2] is not None))]
    assert got == sorted(counted)
    packed = {r.clip_id: bytes(r.blob) for r in binary.pack_frames(df).collect()}
    assert packed == want


def test_offsets_point_at_the_frames(spark):
    rows, df = clips(spark, 2)
    want = archives(rows)
    got = segments.frame_offsets(df, block=16).collect()
    held = {(c, i): raw for c, i, raw in rows if raw is not None}
    assert len(got) == len(held)
    for r in got:
        entry = want[r.clip_id][r.byte_offset:r.byte_offset + 4 + r["size"]]
        assert entry == struct.pack("<I", r["size"]) + held[r.clip_id, r.frame_no]


def test_parts_are_cut_where_sizes_say(spark):
    rows, df = clips(spark, 3)
    parts = binary.pack_frames(df, part_bytes=100, block=16).collect()
    back = {}
    for r in sorted(parts, key=lambda r: (r.clip_id, r.part)):
        n = struct.unpack("<I", r.blob[8:12])[0]
        body, at, own = bytes(r.blob[12:]), 0, []
        while at < len(body):
            k = struct.unpack("<I", body[at:at + 4])[0]
            own.append(body[at + 4:at + 4 + k])
            at += 4 + k
        assert len(own) == n
        back.setdefault(r.clip_id, []).extend(own)
    assert back == {c: [x[2] for x in sorted(r for r in rows if r[0] == c and r[2] is not None)] for c in archives(rows)}


def test_payload_is_exchanged_once(spark):
    _, df = clips(spark, 4)
    df = df.coalesce(1).cache()
    df.count()

    def carrying(frame):
        plan = frame._jdf.queryExecution().executedPlan().toString().split("\n")
        at = [i for i, line in enumerate(plan) if "Exchange hash" in line or "Exchange range" in line]
        return [plan[i] for i in at if any("raw#" in line for line in plan[i + 1:i + 2])]

    for frame in (binary.pack_frames(df), binary.pack_frames(df, part_bytes=100), segments.pack_segments(df)):
        assert len(carrying(frame)) == 1, frame._jdf.queryExecution().executedPlan().toString()
    df.unpersist()


def test_large_archives_are_rejects_and_segments_keep_them(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(binary, "PACK_ROW_BYTES", 1000)
    df = spark.range(100).select(F.lit(1).cast("bigint").alias("clip_id"), F.col("id").alias("frame_no"), F.lit(b"x" * 50).alias("raw"))
    whole = binary.pack_frames(df).first()
    assert whole.blob is None and whole.reject_reason == "too_large"
    segments.write_segments(df, str(tmp_path), 700)
    assert segments.read_segments(spark, str(tmp_path)).where("raw IS NOT NULL").count() == 100


def test_broken_segments(spark):
    entry = struct.pack("<I", 3) + b"abc"
    held = spark.createDataFrame([(1, 5, 2, 0, entry + entry[:2]), (2, 5, 2, 0, entry + entry[:6]), (3, 5, 1, 0, entry + b"?"), (4, 5, 1, 0, entry)], segments.SEGMENTS_DDL)
    got = sorted(segments.unpack_segments(held, segments.segment_manifest(held)).collect(), key=lambda r: (r.clip_id, r.frame_no is None))
    assert [(r.clip_id, r.frame_no, r.reject_reason) for r in got] == [
        (1, 1, None), (1, None, "truncated_length"), (2, 1, None), (2, None, "truncated_payload"), (3, 1, None), (3, None, "trailing_bytes"), (4, 1, None)]


def test_no_frames(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, None)], RAW)
    assert segments.write_segments(df, str(tmp_path)).count() == 0
    assert segments.read_segments(spark, str(tmp_path)).count() == 0
    assert binary.pack_frames(df).count() == binary.pack_frames(df, part_bytes=9).count() == 0
