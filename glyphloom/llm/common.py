"""Shared helpers: packed blocks, counts of 64-bit keys, hashing, components, checkpoints."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A scan task hands over the texts gathered for its blocks when they reach this many bytes.
FLUSH_BYTES = 12 << 20
#: Texts are hashed in chunks of about this many bytes; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 19


#: Blocks per shuffle partition: a Python worker holds one block at a time.
BLOCKS = 2
#: Bytes of text of a block where blocks follow from the input instead.
BLOCK_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where none is set, a local master (tests) gets a temporary one, a cluster an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def give_back() -> None:
    """Return memory that a Python worker has freed to the system: the next worker or the JVM of the executor may need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


# --- packed blocks of documents ---------------------------------------------------------------

def packed_blocks(docs: DataFrame, id_col: str, columns: list[str], blocks: int) -> DataFrame:
    """Deal rows to blocks by id and pack each task's share of a block into one compressed row.

    Returns (block int, payload binary), dealt by block. The columns travel as they are, zstd-packed,
    so that a shuffle of whole texts costs a few large rows and a third of their bytes. A block is
    a bounded slice of the input (`blocks` grows with the shuffle partitions), never a hot key: ids
    are hashed.
    """
    frame = docs.select(*columns).withColumn("__block", F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=4))

        def flush():
            t = pa.Table.from_batches(held)
            ids = t["__block"].to_numpy()
            order = np.argsort(ids, kind="stable")
            t, ids = t.drop_columns(["__block"]).take(pa.array(order)), ids[order]
            names, at = np.unique(ids, return_index=True)
            for b, i, j in zip(names, at, [*at[1:], len(ids)]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, t.schema, options=options) as out:
                    out.write_table(t.slice(i, j - i).combine_chunks())
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "payload"])

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= FLUSH_BYTES:
                yield from flush()
                held, size = [], 0
                give_back()
        if held and sum(map(len, held)):
            yield from flush()
        held = []
        give_back()

    return frame.mapInArrow(pack, "block int, payload binary").repartition(partitions(docs.sparkSession), "block")


def block_count(docs: DataFrame, column: str = "text") -> int:
    """Blocks of BLOCK_BYTES that the texts fill: they follow the input, whatever the number of shuffle partitions."""
    return max(1, -(-(docs.agg(F.sum(F.octet_length(column))).first()[0] or 0) // BLOCK_BYTES))


def scan_blocks(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Stretches of each scan task as blocks, one compressed row each: (block long, payload binary), dealt by block.

    A block ends at BLOCK_BYTES; no key deals rows, so that ids or texts that repeat in any share of the rows
    make no block larger.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, k, held, size = TaskContext.get().partitionId(), 0, [], 0
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=4))

        def row():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=options) as out:
                out.write_table(pa.Table.from_batches(held).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | k], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "payload"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                rest = batch.slice(at)
                # The rows that still fit, but at least one.
                sizes = np.cumsum(pa.compute.binary_length(rest["text"]).fill_null(0).to_numpy())
                n = max(1, int(np.searchsorted(sizes, BLOCK_BYTES - size, "right")))
                n = min(n, rest.num_rows)
                held.append(rest.slice(0, n))
                size += int(sizes[n - 1])
                at += n
                if size >= BLOCK_BYTES or at < batch.num_rows:
                    yield row()
                    k, held, size = k + 1, [], 0
                    give_back()
        if held:
            yield row()
        del held
        give_back()

    return docs.select(*columns).mapInArrow(pack, "block long, payload binary").repartition(partitions(docs.sparkSession), "block")


def unpack(payloads: pa.ChunkedArray | pa.Array) -> pa.Table | None:
    """The rows of one block, in the order of their columns' values (the same in every pass)."""
    tables = [pa.ipc.open_stream(p.as_buffer()).read_all() for p in payloads]
    if not tables:
        return None
    t = pa.concat_tables(tables).combine_chunks()
    return t.sort_by([(f.name, "ascending") for f in t.schema if not pa.types.is_nested(f.type)])


def unpacked_block(payload: pa.Scalar) -> pa.Table:
    """The rows of one block of ``scan_blocks``, in their order."""
    return pa.ipc.open_stream(payload.as_buffer()).read_all().combine_chunks()


def whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The blocks of a partition, each whole: its payloads may be spread over the batches."""
    held: dict[int, list] = {}
    for b in batches:
        for block, payload in zip(b["block"].to_pylist(), b["payload"]):
            held.setdefault(block, []).append(payload)
    for block in list(held):
        yield block, unpack(held.pop(block))
        give_back()


def _table(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> pa.Table:
    got = list(batches)
    give_back()
    return pa.Table.from_batches(got) if got else schema.empty_table()


def grouped(f: Callable, schema: str | StructType) -> Callable:
    """f(key, rows), which yields batches, for applyInArrow on groups."""
    s = arrow_schema(schema)
    return lambda key, t: _table(f(key, t), s)


def cogrouped(f: Callable, schema: str | StructType) -> Callable:
    """f(key, left, right), which yields batches, for applyInArrow on cogroups."""
    s = arrow_schema(schema)
    return lambda key, left, right: _table(f(key, left, right), s)


def arrow_schema(schema: str | StructType) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def texts_of(t: pa.Table, column: str = "text") -> list[bytes | None]:
    return t[column].cast(pa.binary()).to_pylist()


def chunks(texts: list[bytes | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Consecutive texts joined to chunks: (index of the first, bytes, starts with a last end). Null counts as empty."""
    first, size, held = 0, 0, []
    for i, t in enumerate(texts):
        t = t or b""
        if held and size + len(t) > CHUNK_BYTES:
            yield first, np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)])
            first, size, held = i, 0, []
        held.append(t)
        size += len(t)
    if held:
        yield first, np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)])


# --- hashing ----------------------------------------------------------------------------------

_SEED = np.random.Generator(np.random.PCG64(20240601))
_BYTE = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_values(data: np.ndarray) -> np.ndarray:
    """A fixed random 64-bit number for each byte."""
    return _BYTE[data]


class Substrings:
    """Polynomial hashes of any stretch of a sequence of 64-bit values, modulo 2^64."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        if len(_POWERS[0]) < n + 1:
            size = max(n + 1, CHUNK_BYTES + 1)
            inverse = pow(_BASE, -1, 1 << 64)
            for k, base in enumerate((_BASE, inverse)):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                _POWERS[k] = np.multiply.accumulate(p)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * _POWERS[0][:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * _POWERS[1][start]
        return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, starts: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of a chunk, runs of bytes other than U+0020 and U+0009 to U+000D inside one text.

    Returns their hashes (A-Z as a-z if lower), first bytes, ends, and for each text the place of its first word.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(starts), np.int64)
    inside = ~_SPACE[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[starts] = True
    first = np.flatnonzero(inside & (fresh[:-1] | ~np.concatenate([[False], inside[:-1]])))
    end = np.flatnonzero(inside & (fresh[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    values = Substrings(byte_values(_LOWER[data] if lower else data))(first, end)
    return values, first, end, np.searchsorted(first, starts)


# --- keys of blocks, counted over the corpus ----------------------------------------------------

def bucket_rows(block: int, buckets: int, key: np.ndarray, *columns: np.ndarray, wide: bool = False) -> pa.RecordBatch:
    """Rows (bucket, block, key, c0, c1, ...) of packed arrays: a block's sorted keys, dealt by hash bits."""
    which = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(which, kind="stable")
    names, at = np.unique(which[order], return_index=True)
    cut = [order[i:j] for i, j in zip(at, [*at[1:], len(order)])]
    return pa.RecordBatch.from_arrays(
        [pa.array(names.astype(np.int32)), pa.array(np.full(len(names), block, np.int64 if wide else np.int32)), *(pa.array([c[i].tobytes() for i in cut], pa.binary()) for c in (key, *columns))],
        ["bucket", "block", "key", *(f"c{i}" for i in range(len(columns)))])


def bucket_schema(columns: int, block: str = "int") -> str:
    return f"bucket int, block {block}, key binary" + "".join(f", c{i} binary" for i in range(columns))


KEY_BITS = 48


def packed_keys(key: np.ndarray) -> bytes:
    """Ascending KEY_BITS keys as a first one and 32-bit steps (64-bit where a step is too large)."""
    step = np.diff(key)
    return key[:1].tobytes() + step.astype("<u4" if not len(step) or int(step.max()) < 1 << 32 else "<u8").tobytes()


def unpacked_keys(packed: bytes, n: int) -> np.ndarray:
    steps = np.frombuffer(packed, "<u4" if len(packed) == 8 + 4 * (n - 1) else "<u8", offset=8).astype(np.uint64)
    return np.cumsum(np.concatenate([np.frombuffer(packed, np.uint64, count=1), steps]), dtype=np.uint64)


def range_rows(block: int, buckets: int, key: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    """Rows (bucket, block, key, c0) of ascending KEY_BITS keys and their counts, dealt to buckets by equal ranges of the hashed keys."""
    cuts = [0, *np.searchsorted(key, np.array([(i << KEY_BITS) // buckets for i in range(1, buckets)], np.uint64)), len(key)]
    used = [i for i in range(buckets) if cuts[i] < cuts[i + 1]]
    parts = [(key[cuts[i] : cuts[i + 1]], count[cuts[i] : cuts[i + 1]].astype("<u4")) for i in used]
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([block] * len(used), pa.int32()), pa.array([packed_keys(k) for k, _ in parts], pa.binary()), pa.array([c.tobytes() for _, c in parts], pa.binary())], ["bucket", "block", "key", "c0"])


def joined(column: pa.ChunkedArray, dtype) -> np.ndarray:
    """Packed arrays of all rows, one after the other."""
    return np.frombuffer(b"".join(x for x in column.to_pylist()), dtype)


def owners(t: pa.Table, width: int = 8) -> np.ndarray:
    """The block of each packed key."""
    return np.repeat(t["block"].to_numpy(), [len(x) // width for x in t["key"].to_pylist()])


def back_rows(blocks: np.ndarray, key: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (block, key, c0, ...): what a bucket sends back to each block."""
    order = np.argsort(blocks, kind="stable")
    names, at = np.unique(blocks[order], return_index=True)
    cut = [order[i:j] for i, j in zip(at, [*at[1:], len(order)])]
    if len(names):
        yield pa.RecordBatch.from_arrays(
            [pa.array(names), *(pa.array([c[i].tobytes() for i in cut], pa.binary()) for c in (key, *columns))],
            ["block", "key", *(f"c{i}" for i in range(len(columns)))])


def back_schema(columns: int, block: str = "int") -> str:
    return f"block {block}, key binary" + "".join(f", c{i} binary" for i in range(columns))


def found(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key, its place among the sorted ones, and whether it is there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def counted(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.unique(column, return_counts=True)
    return key, n.astype(np.uint32)


# --- connected components -----------------------------------------------------------------------

def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the links a task holds, each node under its smallest."""
    parent: dict[int, int] = {}

    def root(x):
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    for batch in batches:
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for i in range(0, len(nodes), 100_000):
        part = nodes[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a long, b long): (node, component), component the smallest node.

    Only nodes with a link to another node are returned. Each round joins every node's links to its
    smallest neighbour: larger neighbours first, then the smaller ones, until no link changes; rounds
    grow with the logarithm of the longest path. A node with any number of links is an aggregated
    minimum and a join that may be split, never one task's list. Tasks first shrink their own links
    to forests; checkpoints cut the lineage.
    """
    def shrink(df):
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().mapInArrow(_forest, "a long, b long")

    def digest(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = checkpointed(shrink(links))
    seen = digest(now)
    while seen[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        large = large.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        now = checkpointed(small.where("a <> b").distinct())
        before, seen = seen, digest(now)
        if before == seen:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
