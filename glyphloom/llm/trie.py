"""The prefix trie of conversations, with totals of every subtree, by time-forward processing.

A node is the sequence of turns that leads to it, known by a hash that is a running exclusive-or over
hashes of (place, turn): it can be carried over from one range of a sorted conversation to the next,
so that a conversation of any length is spread over tasks. Nodes of a single member need no
passing on; the others are cut into shards, subtrees of at most a bounded number of members. Inside a
shard the nodes are sorted by reverse level order, and totals travel to parents through a priority
queue that spills. What shard roots pass on is added up per parent, and the nodes above all shards,
of which there are few, go through the same pass.
"""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from glyphloom.llm.common import checkpointed, partitions

#: A rebuilt conversation begins with up to HEAD - 1 turns of the first one of its SPAN.
SPAN, HEAD = 100, 6
#: A shard has at most this many members, or a fourth of a partition's share of all.
SHARD_MEMBERS = 1000
#: Nodes above all shards are broadcast up to this many; beyond it their joins are shuffled.
BROADCAST_NODES = 100_000
#: Messages that a queue holds in memory; more go to a sorted run.
QUEUE_ROWS = 1 << 18
#: Runs that a queue reads side by side; at this many they are merged to one.
QUEUE_RUNS = 32
#: Bytes of a list of members that travel as one row.
LIST_BYTES = 1 << 20

NODE = ["depth", "hi", "lo"]
PARENT = ["parent_depth", "parent_hi", "parent_lo"]
SUMS = ["n_children", "n_leaves", "saved_tokens"]


def _hash_parts(value: Column) -> tuple[Column, Column]:
    """120 bits of a text's hash as two numbers."""
    h = F.sha2(value, 256)
    return tuple(F.conv(F.substring(h, at, 15), 16, 10).cast("long") for at in (1, 16))


# --- running counts and hashes over conversations, spread by ranges --------------------------------

def _running(sorted_rows: DataFrame) -> DataFrame:
    """Rows sorted by conversation inside each partition, with counts and exclusive-ors so far, all of the conversation.

    Every partition runs over its own rows; a conversation that goes on in further partitions gets there
    what the ones before it have. Only the last conversation of a partition can go on in the next, so that
    there is less than one such row for each partition.
    """
    kept = sorted_rows.drop("hi", "lo").schema
    names = kept.names
    schema = StructType([*kept.fields, *(StructField(c, LongType()) for c in ("n", "hi", "lo")), StructField("pid", IntegerType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, last, carry = TaskContext.get().partitionId(), None, (0, 0, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch["conv_id"].to_numpy()
            first = np.concatenate([[0], np.flatnonzero(conv[1:] != conv[:-1]) + 1])
            sizes = np.diff([*first, len(conv)])
            out = []
            for k, values in enumerate((np.ones(len(conv), np.int64), batch["hi"].to_numpy(), batch["lo"].to_numpy())):
                op, back = (np.add, np.subtract) if k == 0 else (np.bitwise_xor, np.bitwise_xor)
                total = op.accumulate(values)
                before = np.concatenate([[0], total[first[1:] - 1]])
                run = back(total, np.repeat(before, sizes))
                if conv[0] == last:
                    run[: sizes[0]] = op(run[: sizes[0]], carry[k])
                out.append(run)
            last, carry = conv[-1], tuple(int(x[-1]) for x in out)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), *map(pa.array, out), pa.array(np.full(len(conv), pid, np.int32))], [*names, "n", "hi", "lo", "pid"])

    # Ranges are drawn anew whenever a job runs: both uses below must see the same ones.
    rows = checkpointed(sorted_rows.select(*names, "hi", "lo").mapInArrow(task, schema))
    ends = rows.groupBy("conv_id", "pid").agg(F.max_by(F.struct("n", "hi", "lo"), "n").alias("end"))
    earlier = W.partitionBy("conv_id").orderBy("pid").rowsBetween(W.unboundedPreceding, -1)
    gone_on = ends.select("conv_id", "pid", F.sum("end.n").over(earlier).alias("_n"), F.bit_xor("end.hi").over(earlier).alias("_hi"), F.bit_xor("end.lo").over(earlier).alias("_lo")).where("_n IS NOT NULL")
    joined = rows.join(F.broadcast(gone_on), ["conv_id", "pid"], "left")
    return joined.select(*names, (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"), *(F.col(c).bitwiseXOR(F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in ("hi", "lo")))


def ranked_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, rank from 1, turn_hash, chars): the turns of every conversation in order.

    Ordered by turn, null first, then role and text. Null role or text counts as empty; rows without
    conv_id belong to no conversation and are left out; repeated rows are turns of their own.
    """
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text"]
    placed = rows.repartitionByRange(partitions(conversations.sparkSession), *order).sortWithinPartitions(*order)
    turn_hash = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    zero = F.lit(0).cast("long")
    slim = placed.select("conv_id", turn_hash.alias("turn_hash"), F.length("text").cast("long").alias("chars"), zero.alias("hi"), zero.alias("lo"))
    return _running(slim).select("conv_id", F.col("n").alias("rank"), "turn_hash", "chars")


def rebuilt(conversations: DataFrame, span: int = SPAN, head: int = HEAD) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are compared: their turns as members of nodes, and (conv_id, length) of all, turnless ones too.

    The first h turns are those of the first conversation of the span, h drawn by conv_id; the others
    are a conversation's own. A member is (conv_id, depth, hi, lo, parent_hi, parent_lo, chars, last): the hash
    of all turns up to this depth, and that of those before it.
    """
    turns = checkpointed(ranked_turns(conversations))
    base = F.col("conv_id") - F.col("conv_id") % span
    h = (F.crc32(F.col("conv_id").cast("string")) % head).cast("long")
    convs = turns.groupBy("conv_id").agg(F.max("rank").alias("own")).select("conv_id", "own", base.alias("base"), h.alias("h"))
    heads = turns.where((F.col("rank") < head) & (F.col("conv_id") % span == 0)).select(F.col("conv_id").alias("base"), F.col("rank").alias("depth"), "turn_hash", "chars")
    counts = heads.groupBy("base").agg(F.max("depth").alias("there"))
    taken = F.least("h", F.coalesce("there", F.lit(0).cast("long")))
    rest = F.greatest(F.col("own") - F.col("h"), F.lit(0))
    convs = checkpointed(convs.join(counts, "base", "left").select("conv_id", "base", "h", taken.alias("taken"), (taken + rest).alias("length")))
    borrowed = convs.where("taken > 0").join(heads, "base").where("depth <= taken").select("conv_id", "depth", "turn_hash", "chars", (F.col("depth") == F.col("length")).alias("last"))
    # Skewed only where one conversation has a large share of the turns: such a join is split, its other side being one row.
    depth = F.col("taken") + F.col("rank") - F.col("h")
    kept = turns.join(convs, "conv_id").where("rank > h").select("conv_id", depth.alias("depth"), "turn_hash", "chars", (depth == F.col("length")).alias("last"))
    hi, lo = _hash_parts(F.concat(F.col("depth").cast("string"), F.lit(":"), "turn_hash"))
    rows = borrowed.unionByName(kept).select("conv_id", "depth", "chars", "last", hi.alias("hi"), lo.alias("lo")).withColumns({"turn_hi": F.col("hi"), "turn_lo": F.col("lo")})
    order = ["conv_id", "depth"]
    placed = rows.repartitionByRange(partitions(conversations.sparkSession), *order).sortWithinPartitions(*order)
    before = [F.col(c).bitwiseXOR(F.col(f"turn_{c}")).alias(f"parent_{c}") for c in ("hi", "lo")]
    return _running(placed).select("conv_id", "depth", "hi", "lo", *before, "chars", "last"), convs.select("conv_id", "length")


# --- time-forward processing ----------------------------------------------------------------------

_ENTRY = np.dtype([("level", "<i8"), ("hi", "<i8"), ("lo", "<i8"), ("children", "<i8"), ("leaves", "<i8"), ("saved", "<i8")])


def _merged(entries: Iterator[tuple]) -> Iterator[tuple]:
    """Entries in order, those of one node as one."""
    now = None
    for e in entries:
        if now and now[:3] == e[:3]:
            now = (*now[:3], now[3] + e[3], now[4] + e[4], now[5] + e[5])
        else:
            if now:
                yield now
            now = e
    if now:
        yield now


class Messages:
    """A priority queue of messages (level, hi, lo, children, leaves, saved), least first, that spills sorted runs.

    Runs are nameless scratch files of the task, gone with it; nobody else reads them.
    """

    def __init__(self, rows: int = QUEUE_ROWS, runs: int = QUEUE_RUNS):
        self.heap: list[tuple] = []
        self.rows, self.most, self.runs, self.heads = rows, runs, [], []

    def push(self, message: tuple) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) >= self.rows:
            self._spill(_merged(iter(sorted(self.heap))))
            self.heap = []

    def _spill(self, entries: Iterator[tuple]) -> None:
        if len(self.runs) + 1 >= self.most:
            entries = _merged(heapq.merge(entries, *map(self._rest, self.heads, self.runs)))
            self.runs, self.heads = [], []
        out, held = tempfile.TemporaryFile(), []
        for e in entries:
            held.append(e)
            if len(held) == 1 << 14:
                out.write(np.array(held, _ENTRY).tobytes())
                held = []
        out.write(np.array(held, _ENTRY).tobytes())
        out.seek(0)
        run = self._read(out)
        self.runs.append(run)
        self.heads.append(next(run, None))

    @staticmethod
    def _read(file) -> Iterator[tuple]:
        while got := file.read(_ENTRY.itemsize << 12):
            yield from np.frombuffer(got, _ENTRY).tolist()

    @staticmethod
    def _rest(head: tuple | None, run: Iterator[tuple]) -> Iterator[tuple]:
        if head is not None:
            yield head
            yield from run

    def pop(self, key: tuple) -> tuple[int, int, int]:
        """The sum of all messages to this node, which is the least that has any; those before it must be taken already."""
        total = [0, 0, 0]
        while self.heap and self.heap[0][:3] <= key:
            self._add(total, heapq.heappop(self.heap), key)
        for i, run in enumerate(self.runs):
            while self.heads[i] is not None and self.heads[i][:3] <= key:
                self._add(total, self.heads[i], key)
                self.heads[i] = next(run, None)
        return tuple(total)

    @staticmethod
    def _add(total: list[int], message: tuple, key: tuple) -> None:
        if message[:3] != key:
            raise ValueError("a message to a node that is not in its shard")
        for k in range(3):
            total[k] += message[3 + k]


_PASSED = [*NODE, *PARENT, "top", *SUMS]
TOTALS = ", ".join(f"{c} {'boolean' if c == 'top' else 'long'}" for c in _PASSED)


def _pass_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals of nodes that come by reverse level order: a node's children have all passed on when it comes."""
    queue = Messages()
    for batch in batches:
        if not batch.num_rows:
            continue
        own = [batch[c].to_pylist() for c in ("own", *SUMS)]
        sums = []
        for depth, hi, lo, pd, ph, pl, top, add, children, leaves, saved in zip(*(batch[c].to_pylist() for c in _PASSED[:7]), *own):
            c, n, s = queue.pop((-depth, hi, lo))
            children, leaves, saved = children + c, leaves + n, saved + s + add
            leaves = leaves if children else 1
            sums.append((children, leaves, saved))
            if not top:
                queue.push((-pd, ph, pl, 1, leaves, saved))
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in _PASSED[:7]), *(pa.array(c, pa.int64()) for c in zip(*sums))], _PASSED)


def time_forward(nodes: DataFrame) -> DataFrame:
    """Children, leaves and saved tokens of the subtree of each node; every node's parent is in its partition.

    The parent of a node marked `top` is elsewhere: its totals are returned, but not passed on. `own` are
    the tokens that a node saves itself, and the sums it comes with those that it has from elsewhere.
    """
    return nodes.select(*_PASSED[:7], "own", *SUMS).sortWithinPartitions(F.desc("depth"), "hi", "lo").mapInArrow(_pass_up, TOTALS)


# --- members that end at a node --------------------------------------------------------------------

def ending_hashes(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) from (node, conv_id): the hash of the decimal ids, ascending, joined by commas.

    Ranges of the sorted ids become pieces of the list side by side, whatever their node's share; the hash
    itself, which has to read a list from its begin to its end, reads pieces of up to LIST_BYTES.
    """
    n = partitions(ends.sparkSession)
    keys = [F.col(c) for c in NODE]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(held):
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in list(zip(*held))[:4]), pa.array([h[4] for h in held], pa.binary())], [*NODE, "first", "ids"])

        node, ids, size, held = None, [], 0, []
        for batch in batches:
            for d, hi, lo, c in zip(*(batch[x].to_pylist() for x in (*NODE, "conv_id"))):
                if (d, hi, lo) != node or size >= LIST_BYTES:
                    if ids:
                        held.append((*node, ids[0], ",".join(map(str, ids)).encode()))
                        if size >= LIST_BYTES or len(held) >= 10_000:
                            yield rows(held)
                            held = []
                    node, ids, size = (d, hi, lo), [], 0
                ids.append(c)
                size += len(str(c)) + 1
        if ids:
            held.append((*node, ids[0], ",".join(map(str, ids)).encode()))
        if held:
            yield rows(held)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, h, out = None, None, []
        for batch in batches:
            for d, hi, lo, ids in zip(*(batch[x].to_pylist() for x in NODE), batch["ids"]):
                if (d, hi, lo) == node:
                    h.update(b",")
                else:
                    if node:
                        out.append((*node, h.hexdigest()))
                    node, h = (d, hi, lo), sha256()
                h.update(ids.as_buffer())
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in list(zip(*out))[:3]), pa.array([o[3] for o in out], pa.string())], [*NODE, "ends_sha256"])
                out = []
        if node:
            out.append((*node, h.hexdigest()))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in list(zip(*out))[:3]), pa.array([o[3] for o in out], pa.string())], [*NODE, "ends_sha256"])

    listed = ends.select(*NODE, "conv_id").repartitionByRange(n, *keys, "conv_id").sortWithinPartitions(*keys, "conv_id")
    cut = listed.mapInArrow(pieces, "depth long, hi long, lo long, first long, ids binary")
    return cut.repartition(n, *keys).sortWithinPartitions(*keys, "first").mapInArrow(hashed, "depth long, hi long, lo long, ends_sha256 string")


# --- the trie ---------------------------------------------------------------------------------

def _received(nodes: DataFrame, messages: DataFrame) -> DataFrame:
    """Nodes with the sums of what was sent to them, by key of the parent."""
    sent = messages.groupBy(*PARENT).agg(*(F.sum(c).alias(c) for c in SUMS)).select(*(F.col(p).alias(k) for p, k in zip(PARENT, NODE)), *SUMS)
    return nodes.join(sent, NODE, "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in SUMS})


def prefix_trie(conversations: DataFrame, span: int = SPAN, head: int = HEAD, shard_members: int = SHARD_MEMBERS) -> DataFrame:
    """Every distinct beginning of the rebuilt conversations as a node.

    Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256; (conv_id, depth) names a node. Null role or text counts as empty, rows without conv_id are
    left out, equal turns go by role and text, repeated rows are turns of their own. No conversations give
    no nodes, not even a root. Columns beyond conv_id, turn, role and text are ignored, whatever their names.
    """
    n = partitions(conversations.sparkSession)
    rows, lengths = rebuilt(conversations, span, head)
    members, lengths = checkpointed(rows), checkpointed(lengths)
    most = max(shard_members, lengths.count() // (4 * n))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    # A node's smallest member owns it; the nodes of an owner are the last ones on its path.
    facts = [F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("chars").alias("chars"), *(F.min(f"parent_{c}").alias(f"parent_{c}") for c in ("hi", "lo"))]
    nodes = members.groupBy(*NODE).agg(*facts).withColumns({"parent_depth": F.col("depth") - 1, "own": (F.col("n_convs") - 1) * F.col("chars")})
    nodes = checkpointed(nodes.select(*NODE, *PARENT, "n_convs", "conv_id", "own"))
    nothing = F.lit(None).cast("long")
    root = lengths.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    root = root.select(*(zero.alias(c) for c in NODE), *(nothing.alias(c) for c in PARENT), "n_convs", "conv_id", zero.alias("own"))

    # Nodes of one member pass on one leaf and nothing saved: known without going through them.
    single = nodes.where("n_convs = 1")
    tops = single.groupBy("conv_id").agg(F.min(F.struct("depth", *PARENT)).alias("t")).select("conv_id", "t.*")
    sent = tops.select(*PARENT, one.alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"))

    # Above the shards: at most 4 * n nodes of a level, and a thousandth of all members.
    high = checkpointed(nodes.where(F.col("n_convs") > most).unionByName(root))
    small = high.count() <= BROADCAST_NODES
    hinted = lambda df: F.broadcast(df) if small else df
    below = members.join(hinted(high.select(*NODE)), NODE, "left_anti")
    shards = below.groupBy("conv_id").agg(F.min(F.struct(*NODE)).alias("shard"))
    mid = nodes.where((F.col("n_convs") > 1) & (F.col("n_convs") <= most)).join(shards, "conv_id")
    mid = _received(mid.withColumn("top", F.struct(*NODE) == F.col("shard")), sent).repartition(n, "shard")
    mid_totals = checkpointed(time_forward(mid))
    sent = sent.unionByName(mid_totals.where("top").select(*PARENT, one.alias("n_children"), "n_leaves", "saved_tokens"))
    high_totals = time_forward(_received(high.withColumn("top", F.col("depth") == 0), sent).repartition(1))

    several = nodes.where("n_convs > 1").unionByName(root.where("n_convs > 0"))
    owners = lambda df: df.select(*(F.col(k).alias(p) for p, k in zip(PARENT, NODE)), F.col("conv_id").alias("parent_conv_id"))
    asked = several.where("depth > 0").select("conv_id", "depth", *PARENT).unionByName(tops)
    answered = asked.join(hinted(owners(high)), PARENT, "left")
    low = answered.where("parent_conv_id IS NULL").drop("parent_conv_id").join(owners(nodes.where((F.col("n_convs") > 1) & (F.col("n_convs") <= most))), PARENT)
    parents = answered.where("parent_conv_id IS NOT NULL").unionByName(low).select("conv_id", "depth", "parent_conv_id")

    ends = members.where("last").select(*NODE, "conv_id").unionByName(lengths.where("length = 0").select(*(zero.alias(c) for c in NODE), "conv_id"))
    ended = ending_hashes(ends)
    totals = mid_totals.unionByName(high_totals).select(*NODE, *SUMS)
    summed = several.join(totals, NODE).select(*NODE, "conv_id", "n_convs", *SUMS)
    alone = single.select(*NODE, "conv_id", "n_convs", nothing.alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"))
    out = summed.unionByName(alone).join(ended, NODE, "left").join(parents, ["conv_id", "depth"], "left")
    childless = F.when(F.col("ends_sha256").isNull(), one).otherwise(zero)  # of a single member: it ends here, or goes on
    return out.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id")).alias("parent_conv_id"), "n_convs",
        F.coalesce("n_children", childless).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))
