import struct

from glyphloom.operators.similarity import LoopOptions
from glyphloom.plans.loop_detection import detect_folder_loops, folder_frames
from glyphloom.sources.binary import pack_frames, unpack_frames


def _folder(tmp_path):
    """Nine frames in a period of three; frames 4 to 6 also as colour, frame 9 as colour only, frame 10 broken."""
    for n in range(1, 10):
        text = "abc"[n % 3] * 4
        if n != 9:
            (tmp_path / f"frame_{n:04}.txt").write_text(f"{text}\n{text}\n")
        if n in (4, 5, 6, 9):
            cells = b"".join(bytes([ord(text[0]), n, 2, 3]) for _ in range(8))
            (tmp_path / f"frame_{n:04}.cframe").write_bytes(struct.pack("<II", 4, 2) + cells)
    (tmp_path / "frame_0010.cframe").write_bytes(b"\xff" * 11)
    (tmp_path / "frame_0011.txt").write_text("")


def test_folder_loops(spark, tmp_path):
    _folder(tmp_path)
    rows = {r.frame_no: r for r in folder_frames(spark, str(tmp_path)).collect()}
    assert sorted(rows) == list(range(1, 10))
    assert rows[5].fg[:3] == [5, 2, 3] and rows[1].fg is None and rows[9].glyphs == "a" * 8 and rows[4].exact == "bbbb\nbbbb\n"
    found = detect_folder_loops(spark, str(tmp_path), LoopOptions("visual_text", 3, 2, 0.9)).collect()
    assert [list(r.occurrences) for r in found] == [[1, 4, 7]] and found[0].period_frames == 3


def test_archive_that_no_row_holds(spark, monkeypatch):
    frames = spark.createDataFrame([(c, i, bytes(8)) for c in (1, 2) for i in range(2 + 4 * (c == 2))], "clip_id long, frame_no long, raw binary")
    monkeypatch.setattr("glyphloom.sources.binary.PACK_ROW_BYTES", 40)
    packs = {r.clip_id: r for r in pack_frames(frames).collect()}
    assert packs[1].reject_reason is None and packs[1].blob and (packs[2].blob, packs[2].reject_reason) == (None, "too_large")
    assert sorted(r.reject_reason or "" for r in unpack_frames(pack_frames(frames)).collect()) == ["", "", "too_small"]
    assert unpack_frames(pack_frames(frames, part_bytes=40)).where("reject_reason IS NULL").count() == 8
