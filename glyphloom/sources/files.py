"""Folders of frames, a file each, as a data source: planned partitions, pushed filters, headers alone, committed writes.

The layout is ``path/clip_id=<n>/.../frame_<number>.<ext>``; frames that lie in ``path`` itself belong to the clip
that the option ``clip_id`` names. What the file names decide (clip and number) is decided before a
file is opened, and files are opened only where a column asks for their content.

Writing tasks put files into a folder of their attempt. Only the folders of the attempts that succeeded are moved
to their clips, once all tasks have ended; a failed job leaves nothing behind. An overwrite replaces the clips
written and leaves the others.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from glyphloom.schemas import COLOR_FRAME_GLOB, TEXT_FRAME_GLOB

FORMAT = "frame_files"
#: Per kind of frame: file ending, payload column, and all columns.
KINDS = {
    "text": (TEXT_FRAME_GLOB.rsplit("*", 1)[1], "text", "clip_id bigint, frame_no bigint, bytes bigint, path string, text string"),
    "color": (COLOR_FRAME_GLOB.rsplit("*", 1)[1], "raw", "clip_id bigint, frame_no bigint, bytes bigint, path string, width bigint, height bigint, raw binary"),
}
#: A partition reads files of up to this many bytes and this many files; a task hands over batches of BATCH_BYTES.
SPLIT_BYTES, SPLIT_FILES, BATCH_BYTES = 64 << 20, 4096, 4 << 20
LISTING_THREADS = 16

_TESTS = {
    EqualTo: lambda v, w: v == w, GreaterThan: lambda v, w: v > w, GreaterThanOrEqual: lambda v, w: v >= w, LessThan: lambda v, w: v < w,
    LessThanOrEqual: lambda v, w: v <= w, In: lambda v, w: v in w,
}


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """Where a path lies, and its place there."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path):
        return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return pafs.LocalFileSystem(), path.rstrip("/")


@dataclass
class Files(InputPartition):
    """Files of one task: (clip_id, frame_no, path, bytes)."""

    files: list[tuple[int, int, str, int]]


class FrameReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.kind, self.clip = options["path"], options.get("kind", "color"), int(options.get("clip_id", 0))
        self.split_bytes, self.split_files = int(options.get("split_bytes", SPLIT_BYTES)), int(options.get("split_files", SPLIT_FILES))
        self.schema, self.taken = schema, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Comparisons of clip and number are decided by the names of files; all others are left to Spark."""
        for f in filters:
            if getattr(f, "attribute", None) in (("clip_id",), ("frame_no",)) and (type(f) in _TESTS or type(f) is IsNotNull):
                if type(f) in _TESTS:
                    self.taken.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def _kept(self, column: str, value: int) -> bool:
        return all(_TESTS[test](value, wanted) for c, test, wanted in self.taken if c == column)

    def partitions(self) -> list[Files]:
        """All frames wanted, by clip and number, cut into tasks by bytes. Folders of other clips are not listed."""
        fs, root = file_system(self.path)
        named = re.compile(r"frame_\+?([0-9]+)" + re.escape(KINDS[self.kind][0]) + "$")
        folders, own = [], []
        for entry in fs.get_file_info(pafs.FileSelector(root)):
            clip = re.fullmatch(r"clip_id=(-?[0-9]+)", entry.base_name)
            if entry.type == pafs.FileType.Directory and clip and self._kept("clip_id", int(clip[1])):
                folders.append((int(clip[1]), entry.path))
            elif entry.type == pafs.FileType.File and self._kept("clip_id", self.clip):
                own.append((self.clip, entry))
        with ThreadPoolExecutor(LISTING_THREADS) as pool:
            listed = pool.map(lambda f: [(f[0], e) for e in fs.get_file_info(pafs.FileSelector(f[1], recursive=True)) if e.type == pafs.FileType.File], folders)
            entries = [*own, *(e for part in listed for e in part)]
        files = []
        for clip, entry in entries:
            number = named.fullmatch(entry.base_name)
            if number and int(number[1]) < 1 << 63 and self._kept("frame_no", int(number[1])):
                files.append((clip, int(number[1]), entry.path, entry.size))
        cut, size = [Files([])], 0
        for f in sorted(files):
            if cut[-1].files and (size + f[3] > self.split_bytes or len(cut[-1].files) >= self.split_files):
                cut.append(Files([]))
                size = 0
            cut[-1].files.append(f)
            size += f[3]
        return cut

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.path)
        names, payload = self.schema.names, KINDS[self.kind][1]
        head_only = payload not in names
        opened = not head_only or "width" in names or "height" in names
        schema, rows, size = to_arrow_schema(self.schema), [], 0
        for clip, number, path, n in partition.files:
            data = None
            if opened:
                with fs.open_input_file(path) as f:
                    data = f.read(8) if head_only else f.read()
            sides = {k: int.from_bytes(data[at:at + 4], "little") if data is not None and n >= 8 else None for k, at in (("width", 0), ("height", 4))}
            value = {"clip_id": clip, "frame_no": number, "bytes": n, "path": path, **sides}
            if not head_only:
                value[payload] = data.decode("utf-8", "replace") if self.kind == "text" else data
            rows.append([value[c] for c in names])
            size += len(data or b"") + 100
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


@dataclass
class Written(WriterCommitMessage):
    """Folders that one successful attempt filled: (clip_id, folder, frames)."""

    task: int
    folders: list[tuple[int, str, int]]


class FrameWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.kind, self.overwrite, self.job = options["path"], options.get("kind", "color"), overwrite, uuid.uuid4().hex
        missing = {"clip_id", "frame_no", KINDS[self.kind][1]} - set(schema.names)
        if missing:
            raise ValueError(f"frames to write lack {sorted(missing)}")

    def _staging(self, root: str) -> str:
        return f"{root}/_staging-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = file_system(self.path)
        context = TaskContext.get()
        ending, payload, _ = KINDS[self.kind]
        here = f"{self._staging(root)}/{context.partitionId()}-{context.taskAttemptId()}"
        counts: dict[int, int] = {}
        for batch in iterator:
            for clip, number, value in zip(batch["clip_id"].to_pylist(), batch["frame_no"].to_pylist(), batch[payload].to_pylist()):
                if clip is None or number is None or number < 0 or value is None:
                    raise ValueError(f"no frame to write: clip {clip}, number {number}")
                if clip not in counts:
                    fs.create_dir(f"{here}/{clip}", recursive=True)
                with fs.open_output_stream(f"{here}/{clip}/frame_{number:06d}{ending}") as out:
                    out.write(value.encode() if isinstance(value, str) else value)
                counts[clip] = counts.get(clip, 0) + 1
        return Written(context.partitionId(), [(c, f"{here}/{c}", n) for c, n in counts.items()])

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        replaced = set()
        for m in messages:
            for clip, folder, _ in m.folders if m else ():
                home = f"{root}/clip_id={clip}"
                fs.create_dir(home, recursive=True)
                if self.overwrite and clip not in replaced:
                    replaced.add(clip)
                    for old in fs.get_file_info(pafs.FileSelector(home)):
                        fs.delete_dir(old.path) if old.type == pafs.FileType.Directory else fs.delete_file(old.path)
                fs.move(folder, f"{home}/{self.job}-{m.task}")
        self._clear(fs, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*file_system(self.path))

    def _clear(self, fs: pafs.FileSystem, root: str) -> None:
        if fs.get_file_info(self._staging(root)).type == pafs.FileType.Directory:
            fs.delete_dir(self._staging(root))


class FrameFiles(DataSource):
    """``spark.read.format("frame_files")``: options path, kind (text or color), clip_id, split_bytes, split_files."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return KINDS[self.options.get("kind", "color")][2]

    def reader(self, schema: StructType) -> FrameReader:
        return FrameReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> FrameWriter:
        return FrameWriter(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with pushed filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FrameFiles)


def read_frame_files(spark: SparkSession, path: str, kind: str = "color", columns: list[str] | None = None, **options) -> DataFrame:
    """Frames of a folder with the columns asked for (see ``KINDS``): without the payload only headers are read, or nothing but names."""
    register(spark)
    every = StructType.fromDDL(KINDS[kind][2])
    return spark.read.format(FORMAT).schema(StructType([every[c] for c in columns or every.names])).options(kind=kind, **options).load(path)


def write_frame_files(frames: DataFrame, path: str, kind: str = "color", overwrite: bool = True) -> None:
    """One file per frame (clip_id, frame_no, and text or raw). Every frame is written once, whichever tasks were tried again."""
    register(frames.sparkSession)
    chosen = frames.select("clip_id", "frame_no", KINDS[kind][1])
    chosen.write.format(FORMAT).mode("overwrite" if overwrite else "append").option("kind", kind).save(path)
