"""N-gram Jaccard join by prefix trees over globally ordered shingle sets.

Shingles are ordered by document frequency, rare first (ties by hash). Two sets that reach the
threshold share a shingle among the first few of both, so a set meets others only through its own
rare shingles; shingles of one document need no meeting at all. Sets that meet are kept as a trie in
one task: a probe walks it once, shares the overlap of common beginnings, and leaves a subtree when
the remaining lengths cannot make up what is missing, or when everything in it is already connected.

Only connected components are asked for, so no task emits more than a spanning forest of its sets,
and equal sets are one set. First every set meets the smallest set of each of its rare shingles (a
star, split to cells of bounded size); then only shingles that still bring different components together are
joined, large groups as pairs of chunks. Every pair that shares a rare shingle is thus compared or
already connected: no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.llm.common import (BLOCKS, KEY_BITS, Substrings, back_schema, bucket_schema, checkpointed, chunks, cogrouped, components, counted, found,
                                  grouped, packed_blocks, packed_keys, partitions, range_rows, texts_of, unpack, unpacked_keys, whole_blocks, words)

#: Sets that one trie holds.
CELL = 1000


def _shingles(t: pa.Table, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each chunk: place of its first text, distinct shingle hashes sorted by text, and where each text's begin."""
    for first, data, starts in chunks(texts_of(t)):
        values, _, _, at = words(data, starts)
        n = np.diff(at)
        hashed = Substrings(values)
        count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
        text = np.repeat(np.arange(len(n)), count)
        begin = np.repeat(at[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        key = hashed(begin, np.minimum(begin + size, at[1:][text])) >> np.uint64(64 - KEY_BITS) if len(begin) else np.zeros(0, np.uint64)
        order = np.lexsort((key, text))
        key, text = key[order], text[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
        yield first, key[new], np.searchsorted(text[new], np.arange(len(n) + 1))


def _class(frequency: np.ndarray) -> np.ndarray:
    """Document frequency as a byte that never falls as it grows: the shingles' global order is by it, then by hash."""
    return np.minimum(8 * np.log2(frequency), 255).astype(np.uint8)


def _narrow(key: np.ndarray) -> bytes:
    return np.ascontiguousarray(key).view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8].tobytes()


def _wide(packed: bytes) -> np.ndarray:
    part = np.frombuffer(packed, np.uint8).reshape(-1, KEY_BITS // 8)
    out = np.zeros((len(part), 8), np.uint8)
    out[:, : KEY_BITS // 8] = part
    return out.view(np.uint64).ravel()


class Trie:
    """Sets as sorted tuples of ranks; equal beginnings are shared. Subtrees are ranges of the sorted sets."""

    def __init__(self, sets: list[tuple], full: list[int]):
        order = sorted(range(len(sets)), key=sets.__getitem__)
        self.order, self.sets, self.full = order, [sets[i] for i in order], [full[i] for i in order]
        self.common = [0] + [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(self.sets, self.sets[1:])]
        self.known: dict = {}

    def node(self, lo: int, hi: int, depth: int):
        """Shared ranks after depth, the depth they end at, children, least size and longest remainder of the range."""
        if (n := self.known.get((lo, hi))) is None:
            end = len(self.sets[lo]) if hi - lo == 1 else min(self.common[lo + 1 : hi])
            cuts = [lo, *(i for i in range(lo + 1, hi) if self.common[i] == end), hi] if hi - lo > 1 else []
            n = self.known[lo, hi] = (self.sets[lo][depth:end], end, list(zip(cuts, cuts[1:])), min(self.full[lo:hi]), max(map(len, self.sets[lo:hi])))
        return n


def trie_links(sets: list[np.ndarray], frequency: list[np.ndarray], full: list[int], component: list[int], num: int, den: int) -> list[tuple[int, int]]:
    """Links (indexes) that connect all of the given sets that are connected by pairs of Jaccard >= num/den.

    sets hold the shingles found in other documents, full the size of the whole set. Sets of one
    component already are not compared.
    """
    key, df = np.concatenate(sets), np.concatenate(frequency)
    order = np.lexsort((key, df))
    new = np.ones(len(key), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (df[order][1:] != df[order][:-1])
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(new)
    at = np.cumsum([0, *map(len, sets)])
    trie = Trie([tuple(np.sort(rank[a:b]).tolist()) for a, b in zip(at, at[1:])], full)
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    group = [component[i] for i in trie.order]
    left = len(set(group))
    links = []
    for x, (own, nx) in enumerate(zip(trie.sets, trie.full)):
        if left == 1:
            break
        mine = set(own)
        # Places in `own` by rank give what is left of the probe after a node.
        stack = [(0, len(trie.sets), 0, 0, 0)]
        while stack:
            lo, hi, depth, overlap, passed = stack.pop()
            if hi <= x + 1:
                continue
            if hi - lo == 1 and root(group[lo]) == root(group[x]):
                continue
            shared, end, children, least, longest = trie.node(lo, hi, depth)
            need = -(-num * (nx + least) // (num + den))
            if overlap + min(len(own) - passed, longest - depth) < need:
                continue
            overlap += len(mine.intersection(shared))
            if hi - lo == 1:
                if overlap * (num + den) >= num * (nx + least):
                    parent[root(group[lo])] = root(group[x])
                    links.append((trie.order[x], trie.order[lo]))
                    left -= 1
                continue
            if shared:
                last = shared[-1]
                a, b = passed, len(own)
                while a < b:
                    m = (a + b) // 2
                    a, b = (m + 1, b) if own[m] <= last else (a, m)
                passed = a
            if overlap + min(len(own) - passed, longest - end) >= need:
                stack += [(a, b, end, overlap, passed) for a, b in children]
    return links


def near_components(docs: DataFrame, size: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """Components of documents linked by a Jaccard similarity of word shingles of at least num/den.

    docs needs doc_id (long) and text. Words are runs of bytes other than U+0020 and U+0009 to
    U+000D, A-Z taken as a-z; a set is the distinct shingles of `size` words, of a shorter text its
    whole sequence. Texts without words have an empty set and no links. Returns (doc_id, n_shingles,
    component_id), a row per input row; component_id is the smallest doc_id reachable. Rows of one
    doc_id are one node; rows without doc_id get a null component_id and link nothing.
    Shingles are compared by 48-bit hashes.
    """
    n = partitions(docs.sparkSession)
    blocks = packed_blocks(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id", ["doc_id", "text"], BLOCKS * n)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, t in whole_blocks(batches):
            parts = [key for _, key, _ in _shingles(t, size)]
            key, count = counted(np.concatenate(parts)) if parts else (np.zeros(0, np.uint64), None)
            if len(key):
                yield range_rows(block, n, key, count)

    def repeated(_, t: pa.Table) -> Iterator[pa.RecordBatch]:
        """Shingles of two documents or more, and their order class, to every block that has them."""
        counts = [np.frombuffer(c, "<u4") for c in t["c0"].to_pylist()]
        keys = [unpacked_keys(k, len(c)) for k, c in zip(t["key"].to_pylist(), counts)]
        key, count = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        group = np.empty(len(key), np.int64)
        group[order] = np.cumsum(new) - 1
        total = np.bincount(group, weights=count)[group]
        keep = total >= 2
        ends = np.cumsum([0, *map(len, keys)])
        rows = [(b, key[i:j][keep[i:j]], _class(total[i:j][keep[i:j]])) for b, i, j in zip(t["block"].to_pylist(), ends, ends[1:]) if keep[i:j].any()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([packed_keys(r[1]) for r in rows], pa.binary()), pa.array([r[2].tobytes() for r in rows], pa.binary())], ["block", "key", "c0"])

    set_schema = "doc_id long, n_shingles long, block int, sig binary, keys binary, dfs binary, prefix int"

    def ordered(key: tuple, left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
        """Each text's size; for one that may have a partner also its shared shingles in order and how many are in its prefix."""
        if not left.num_rows:
            return
        classes = [np.frombuffer(c, np.uint8) for c in right["c0"].to_pylist()]
        known = np.concatenate([np.zeros(0, np.uint64), *(unpacked_keys(k, len(c)) for k, c in zip(right["key"].to_pylist(), classes))])
        order = np.argsort(known)
        known, df = known[order], np.concatenate([np.zeros(0, np.uint8), *classes])[order]
        t = unpack(left["payload"].combine_chunks())
        ids, seen = t["doc_id"].to_pylist(), set()
        out: list[list] = [[] for _ in range(7)]
        for first, shingle, starts in _shingles(t, size):
            at, there = found(known, shingle)
            for i, (a, b) in enumerate(zip(starts.tolist(), starts[1:].tolist())):
                total, shared = int(b - a), int(there[a:b].sum())
                prefix = total - -(-num * total // den) + 1 - (total - shared)
                row = [ids[first + i], total, key[0].as_py(), None, None, None, None]
                if shared and prefix > 0 and row[0] is not None:
                    row[3] = blake2b(shingle[a:b].tobytes(), digest_size=16).digest()
                    if row[3] not in seen:
                        seen.add(row[3])
                        k, f = shingle[a:b][there[a:b]], df[at[a:b][there[a:b]]]
                        o = np.lexsort((k, f))
                        row[4:] = _narrow(k[o]), f[o].tobytes(), min(prefix, shared)
                for c, v in zip(out, row):
                    c.append(v)
        types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(out, types)], ["doc_id", "n_shingles", "block", "sig", "keys", "dfs", "prefix"])

    back = blocks.mapInArrow(frequencies, bucket_schema(1)).groupBy("bucket").applyInArrow(grouped(repeated, back_schema(1)), back_schema(1))
    rows = checkpointed(blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(cogrouped(ordered, set_schema), set_schema))

    # Equal sets are one node, carried by the first block that has it. Rows of one doc_id are connected.
    node = F.when(F.col("sig").isNotNull(), F.xxhash64("sig")).otherwise(F.xxhash64(F.col("doc_id"), F.lit("alone")))
    named = rows.select("doc_id", "n_shingles", node.alias("node"))
    carriers = rows.where("keys IS NOT NULL").groupBy(node.alias("node")).agg(F.min("block").alias("block"))
    payload = rows.where("keys IS NOT NULL").select(node.alias("node"), "block", F.col("n_shingles").cast("int").alias("full"), "keys", "dfs", "prefix")
    twice = named.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first <> last").select("doc_id", "first")
    links = _links(payload, checkpointed(carriers), num, den).union(named.join(twice, "doc_id").select("first", "node"))
    comps = components(links)
    comps = checkpointed(comps.union(comps.select("component", "component")).distinct())
    least = comps.join(named, "node").groupBy("component").agg(F.min("doc_id").alias("least"))
    least = comps.join(least, "component").select("node", "least")
    alone = named.groupBy("node").agg(F.min("doc_id").alias("own"))
    least = alone.join(least, "node", "left").select("node", F.coalesce("least", "own").alias("component_id"))
    return named.join(least, "node").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def _links(payload: DataFrame, carriers: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) that give the components of sets (node, block, full, keys, dfs, prefix), each taken from the block that carriers (node, block) name."""
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prefix = b["prefix"].to_pylist()
            keys = [_wide(k[: p * KEY_BITS // 8]).astype(np.int64) for k, p in zip(b["keys"].to_pylist(), prefix)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)), pa.array(np.repeat(b["node"].to_numpy(), prefix)), pa.array(np.repeat(b["block"].to_numpy(), prefix))], ["token", "rep", "block"])

    def cell(key: tuple, t: pa.Table) -> Iterator[pa.RecordBatch]:
        rep, full, comp = t["rep"].to_pylist(), t["full"].to_pylist(), t["comp"].to_pylist()
        keys = [_wide(x) for x in t["keys"].to_pylist()]
        dfs = [np.frombuffer(x, np.uint8) for x in t["dfs"].to_pylist()]
        pairs = trie_links(keys, dfs, full, comp, num, den)
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array([rep[x] for x, _ in pairs], pa.int64()), pa.array([rep[y] for _, y in pairs], pa.int64())], ["a", "b"])

    shared = payload.mapInArrow(prefixes, "token long, rep long, block int").join(carriers.withColumnRenamed("node", "rep"), ["rep", "block"], "left_semi")
    shared = checkpointed(shared.select("token", "rep"))
    payload = payload.join(carriers, ["node", "block"], "left_semi").select(F.col("node").alias("rep"), "full", "keys", "dfs")
    meeting = shared.groupBy("token").agg(F.count("*").alias("n"), F.min("rep").alias("pivot")).where("n > 1")

    # Stars: every set with the smallest one of each of its prefix shingles, in cells.
    star = checkpointed(shared.join(meeting.select("token", "pivot"), "token").where("rep <> pivot").select("pivot", "rep").distinct())
    cells = star.groupBy("pivot").agg(F.count("*").alias("n")).select("pivot", F.ceil(F.col("n") / CELL).cast("int").alias("cells"))
    members = star.join(cells, "pivot").select("pivot", F.pmod(F.xxhash64("rep"), "cells").cast("int").alias("cell"), "rep")
    centres = cells.select("pivot", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), F.col("pivot").alias("rep"))
    first = members.union(centres).join(payload, "rep").withColumn("comp", F.col("rep")).groupBy("pivot", "cell").applyInArrow(grouped(cell, "a long, b long"), "a long, b long")
    comps = components(first)

    # Shingles that still join different components; those with the same sets count once.
    current = shared.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("token", "rep", F.coalesce("component", "rep").alias("comp"))
    open_tokens = current.groupBy("token").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("x")).where("lo <> hi")
    open_tokens = open_tokens.groupBy("n", "s", "x").agg(F.min("token").alias("token")).select("token", F.ceil(F.col("n") / CELL).cast("int").alias("chunks"))
    mine = F.pmod(F.xxhash64("rep"), "chunks").cast("int")
    parts = current.join(open_tokens, "token").select("token", "rep", "comp", mine.alias("own"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    parts = parts.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "comp")
    second = parts.join(payload, "rep").groupBy("token", "i", "j").applyInArrow(grouped(cell, "a long, b long"), "a long, b long")
    return comps.select(F.col("node").alias("a"), F.col("component").alias("b")).union(second)
