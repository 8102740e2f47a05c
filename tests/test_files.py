import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from glyphloom.sources import files

RAW = "clip_id bigint, frame_no bigint, raw binary"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def frame(w, h, n=20):
    return w.to_bytes(4, "little") + h.to_bytes(4, "little") + bytes(n)


def stored(path):
    return sorted(os.path.join(d, f)[len(path):].split("/")[1] + "/" + f for d, _, fs in os.walk(path) for f in fs if not f.startswith("."))


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(c, i, frame(i, abs(c), i)) for c in (1, 2, -3) for i in range(30)]
    files.write_frame_files(spark.createDataFrame(rows, RAW).repartition(4), str(tmp_path))
    return str(tmp_path), rows


def test_round_trip(spark, folder):
    path, rows = folder
    got = files.read_frame_files(spark, path).collect()
    assert sorted((r.clip_id, r.frame_no, bytes(r.raw)) for r in got) == sorted(rows)
    assert all((r.width, r.height, r.bytes) == (r.frame_no, int.from_bytes(r.raw[4:8], "little"), len(r.raw)) for r in got)
    assert all(os.path.basename(r.path) == f"frame_{r.frame_no:06d}.cframe" for r in got)
    assert not [n for n in os.listdir(path) if n.startswith("_")]
    small = files.read_frame_files(spark, path, split_files=7)
    assert small.rdd.getNumPartitions() == -(-90 // 7) and small.count() == 90


def test_headers_without_payload(spark, folder):
    path, _ = folder
    torn = os.path.join(path, "clip_id=1", "more")
    os.makedirs(torn)
    for name, data in (("frame_000100.cframe", b"abc"), ("frame_000101.cframe", frame(7, 8)[:9]), ("note_1.cframe", b""), ("frame_99999999999999999999.cframe", b"")):
        with open(os.path.join(torn, name), "wb") as f:
            f.write(data)
    got = {(r.clip_id, r.frame_no): r for r in files.read_frame_files(spark, path, "color", ["clip_id", "width", "height", "frame_no", "bytes"]).collect()}
    assert len(got) == 92
    assert (got[1, 100].width, got[1, 100].bytes) == (None, 3) and (got[1, 101].width, got[1, 101].height) == (7, 8)
    names = files.read_frame_files(spark, path, "color", ["frame_no", "clip_id"])
    assert names.agg(F.sum("frame_no")).first()[0] == 3 * 435 + 201


def test_filters_are_pushed(spark, folder):
    path, rows = folder
    df = files.read_frame_files(spark, path)
    asked = df.where("clip_id IN (1, -3) AND frame_no >= 5 AND frame_no < 9 AND width <> 6")
    plan = asked._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pushed = next(line for line in plan.split("\n") if "PushedFilters" in line)
    assert "clip_id" in pushed and "frame_no" in pushed
    assert sorted((r.clip_id, r.frame_no) for r in asked.collect()) == sorted((c, i) for c in (1, -3) for i in (5, 7, 8))
    reader = files.FrameReader({"path": path}, df.schema)
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual
    left = list(reader.pushFilters([EqualTo(("clip_id",), 2), GreaterThan(("frame_no",), 20), LessThanOrEqual(("width",), 3)]))
    assert left == [LessThanOrEqual(("width",), 3)]
    assert [(c, i) for p in reader.partitions() for c, i, *_ in p.files] == [(2, i) for i in range(21, 30)]


def test_overwrite_replaces_the_clips_written(spark, folder):
    path, rows = folder
    files.write_frame_files(spark.createDataFrame([(2, 500, b"new")], RAW), path)
    assert stored(path) == sorted([f"clip_id={c}/frame_{i:06d}.cframe" for c, i, _ in rows if c != 2] + ["clip_id=2/frame_000500.cframe"])
    files.write_frame_files(spark.createDataFrame([(2, 501, b"more")], RAW), path, overwrite=False)
    got = files.read_frame_files(spark, path).where("clip_id = 2").collect()
    assert sorted((r.frame_no, bytes(r.raw)) for r in got) == [(500, b"new"), (501, b"more")]


def test_text_frames(spark, tmp_path):
    rows = [(1, 1, "a é\n"), (1, 2, ""), (2, 1, "x")]
    files.write_frame_files(spark.createDataFrame(rows, "clip_id bigint, frame_no bigint, text string"), str(tmp_path), "text")
    assert sorted((r.clip_id, r.frame_no, r.text) for r in files.read_frame_files(spark, str(tmp_path), "text").collect()) == rows
    with open(tmp_path / "frame_7.txt", "w") as f:
        f.write("loose")
    assert files.read_frame_files(spark, str(tmp_path), "text", clip_id=9).where("clip_id = 9").first().text == "loose"


RETRIED = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark import TaskContext
from pyspark.sql import SparkSession
from glyphloom.sources import files
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.execution.arrow.maxRecordsPerBatch", "5").getOrCreate()
df = spark.range(40, numPartitions=4).selectExpr("id % 2 AS clip_id", "id AS frame_no", "CAST(concat('frame ', id) AS binary) AS raw")
failing = int(sys.argv[3])
def torn(batches):
    for k, b in enumerate(batches):
        if k == 1 and TaskContext.get().attemptNumber() < failing:
            raise RuntimeError("lost after the first frames")
        yield b
try:
    files.write_frame_files(df.mapInArrow(torn, df.schema), sys.argv[2])
    print("written")
except Exception as e:
    print("failed", type(e).__name__)
"""


@pytest.mark.parametrize("failing", [1, 9])
def test_tried_again_or_given_up(tmp_path, failing):
    path = tmp_path / "frames"
    kept = path / "clip_id=1" / "old"
    kept.mkdir(parents=True)
    (kept / "frame_000999.cframe").write_bytes(b"old")
    run = subprocess.run([sys.executable, "-c", RETRIED, ROOT, str(path), str(failing)], capture_output=True, text=True, timeout=300)
    want = {f"clip_id={i % 2}/frame_{i:06d}.cframe" for i in range(40)} if failing == 1 else {"clip_id=1/frame_000999.cframe"}
    assert ("written" if failing == 1 else "failed") in run.stdout, run.stderr[-2000:]
    assert stored(str(path)) == sorted(want)
    assert not [n for n in os.listdir(path) if n.startswith("_")]
