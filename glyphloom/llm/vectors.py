"""Vectors: near duplicates by a random-projection forest, neighbours by randomly rotated one-bit codes with a certain error bound."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphloom.llm.common import checkpointed, cogrouped, components, grouped, partitions

#: Vectors that the trees' upper splits are fitted on, at most.
FIT_ROWS = 20_000
#: Fewest trees; rows of a leaf aimed at; spill on either side of a split, in standard deviations; rows that one task compares.
TREES, LEAF, SPILL, CELL = 10, 128, 0.1, 2000
#: Share of pairs at cosine 0.9 that one split keeps together (with SPILL, as measured), and the share of them that all trees may miss.
TOGETHER, MISSED = 0.92, 0.005
#: Fewest sample rows behind a fitted split.
SPLIT_ROWS = 24
#: Rows and queries of a search cell at most, rows of one at least; one-bit codes of a vector, each of what the ones before leave.
ROWS, QUERIES, FEWEST, CODES = 32768, 16384, 2048, 8


def usable(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, v array<double>) of the rows with an id whose vector can be compared: not null, not zero, all components finite.

    Vectors of several dimensions may be among them; only those of one dimension are comparable. Equal rows count once.
    """
    v = F.col(vector).cast("array<double>")
    fine = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return fine.where(F.col("v").isNotNull() & finite).distinct()


def _by_dimension(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The rows of a batch with vectors `v` of one dimension, and these as a matrix."""
    size = b["v"].value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(size):
        part = b if (size == d).all() else b.take(pa.array(np.flatnonzero(size == d)))
        yield part, _matrix(part["v"])


def _matrix(column) -> np.ndarray:
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1) if len(c) else np.zeros((0, 0))


class Tree:
    """A binary tree of random directions. Upper thresholds are sample medians; below them, directions and
    thresholds follow from the node's path and its sample mean, so that any task places a vector alike."""

    def __init__(self, seed: int, sample: np.ndarray, depth: int):
        self.seed, self.dim, self.depth = seed, sample.shape[1], depth
        self.fitted: dict[int, tuple[float, float]] = {}
        self.means: dict[int, np.ndarray] = {}
        self._fit(1, sample, 0)

    def direction(self, node: int) -> np.ndarray:
        w = np.random.Generator(np.random.PCG64([self.seed, node])).standard_normal(self.dim)
        return w / np.linalg.norm(w)

    def _fit(self, node: int, x: np.ndarray, level: int) -> None:
        if level == self.depth or len(x) < 2 * SPLIT_ROWS:
            self.means[node] = x.mean(0) if len(x) else np.zeros(self.dim)
            return
        side = x @ self.direction(node)
        self.fitted[node] = float(np.median(side)), float(side.std())
        self._fit(2 * node, x[side <= self.fitted[node][0]], level + 1)
        self._fit(2 * node + 1, x[side > self.fitted[node][0]], level + 1)

    def leaves(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows of x in it); spill puts rows near a split on both sides."""
        stack = [(1, np.arange(len(x)), 0, None)]
        while stack:
            node, rows, level, mean = stack.pop()
            if not len(rows):
                continue
            if level == self.depth:
                yield node, rows
                continue
            mean = self.means.get(node, mean)
            w = self.direction(node)
            side = x[rows] @ w
            at, spread = self.fitted.get(node) or (float(mean @ w), 1.0 / np.sqrt(self.dim))
            stack.append((2 * node, rows[side <= at + SPILL * spread], level + 1, mean))
            stack.append((2 * node + 1, rows[side > at - SPILL * spread], level + 1, mean))


def trees_for(depth: int) -> int:
    """Trees of `depth` splits that together miss at most MISSED of the pairs at cosine 0.9: each keeps TOGETHER**depth of them."""
    alone = TOGETHER**depth
    return TREES if alone > 0.9 else max(TREES, int(np.ceil(np.log(MISSED) / np.log1p(-alone))))


def _settle(near: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each, by a symmetric boolean matrix."""
    label = np.arange(len(near))
    while True:
        least = np.minimum(label, np.where(near, label[None, :], len(near)).min(1))
        least = least[least]
        if (least == label).all():
            return label
        label = least


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", least: float = 0.9, trees: int | None = None) -> DataFrame:
    """(id_col, n_links, component_id, kept) of every row: links are pairs with cosine >= least that share a leaf of some tree.

    Equal vectors are one point with a multiplicity. There are as many trees as their depth asks for (see trees_for); vectors
    are compared with those of their own dimension, and only the most frequent dimension has splits fitted on a sample. Points are compared within leaves only, in double
    precision; a pair counts at the first leaf it shares, so counts need no list of pairs, and a task
    emits a row per point. Leaves over CELL points are compared as pairs of chunks. Rows that cannot
    be compared (see usable) have no links and are their own component; without id that is null and
    kept is false.
    """
    points = checkpointed(usable(vectors, id_col, vector).groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("mult")))
    n = points.count()
    depth = max(0, int(np.ceil(np.log2(max(n, 1) / LEAF))))
    trees = trees or trees_for(depth)
    usual = points.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    usual = usual[0]["d"] if usual else 1
    sample = points.where(F.size("v") == usual).select("rep", "v").orderBy(F.xxhash64("rep")).limit(FIT_ROWS).select("v").toArrow()["v"]
    sample = _matrix(sample)
    sample = sample / np.linalg.norm(sample, axis=1, keepdims=True) if len(sample) else sample.reshape(0, 1)
    forest = [Tree(k, sample, depth) for k in range(trees)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b, x in _by_dimension(whole):
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                rows, codes = [], []
                for k, t in enumerate(forest if x.shape[1] == usual else [Tree(k, np.zeros((0, x.shape[1])), depth) for k in range(trees)]):
                    for leaf, r in t.leaves(x):
                        rows.append(r)
                        codes.append(np.full(len(r), k << 56 | leaf))
                rows, codes = np.concatenate(rows), np.concatenate(codes)
                order = np.lexsort((codes, rows))
                ends = np.searchsorted(rows[order], np.arange(b.num_rows + 1))
                held = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(codes[order]))
                yield pa.RecordBatch.from_arrays([b["rep"], b["mult"], b["v"], held, pa.array(np.full(b.num_rows, x.shape[1], np.int32))], ["rep", "mult", "v", "codes", "d"])

    placed = checkpointed(points.select("rep", "mult", "v").mapInArrow(place, "rep long, mult long, v array<double>, codes array<long>, d int"))
    member = placed.select("rep", "d", F.explode("codes").alias("code"))
    chunked = member.groupBy("code", "d").agg(F.count("*").alias("n")).where("n > 1").select("code", "d", F.ceil(F.col("n") / CELL).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("rep"), "chunks").cast("int")
    cells = member.join(chunked, ["code", "d"]).select("code", "d", "rep", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    cells = cells.select("code", "d", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep").join(placed.drop("d"), "rep")
    schema = "rep long, n long, link long"

    def compare(key: tuple, t: pa.Table) -> Iterator[pa.RecordBatch]:
        code, _, i, j = (k.as_py() for k in key)
        rep = t["rep"].to_numpy()
        order = np.argsort(rep)
        t, rep = t.take(pa.array(order)), rep[order]
        x, mult, side = _matrix(t["v"]), t["mult"].to_numpy(), t["own"].to_numpy()
        norm = np.linalg.norm(x, axis=1)
        near = (x @ x.T) / (norm[:, None] * norm[None, :]) >= least
        np.fill_diagonal(near, False)
        if i != j:
            near &= side[:, None] != side[None, :]
        if not near.any():
            return
        label = _settle(near)
        codes = t["codes"].combine_chunks()
        flat, size = codes.flatten().to_numpy(), codes.value_lengths().to_numpy()
        earlier = flat < code
        names, at = np.unique(flat[earlier], return_inverse=True)
        held = np.zeros((len(rep), len(names)), np.float32)
        held[np.repeat(np.arange(len(rep)), size)[earlier], at] = 1
        first = near & ~(held @ held.T > 0)
        count = first @ mult
        keep = (count > 0) | (label != np.arange(len(rep)))
        yield pa.RecordBatch.from_arrays([pa.array(rep[keep]), pa.array(count[keep]), pa.array(rep[label[keep]])], ["rep", "n", "link"])

    found = checkpointed(cells.groupBy("code", "d", "i", "j").applyInArrow(grouped(compare, schema), schema))
    linked = found.groupBy("rep").agg(F.sum("n").alias("n"))
    comps = components(found.select(F.col("rep").alias("a"), F.col("link").alias("b")))
    classes = points.join(linked, "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    classes = classes.select("v", (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    every = vectors.select(F.col(id_col).cast("long").alias(id_col), F.col(vector).cast("array<double>").alias("v"))
    out = every.join(classes, (every["v"] == classes["v"]) & every[id_col].isNotNull(), "left").select(id_col, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", id_col).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: DataFrame) -> DataFrame:
    """(id, v, code binary, scales, norm, rest): sign bits of the rotated unit vector and of what the codes before leave, the factor of
    each code, the vector's length, and the length of what all codes leave of the unit vector."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b, x in _by_dimension(whole):
                peak = np.abs(x).max(1, keepdims=True)
                length = np.linalg.norm(x / peak, axis=1, keepdims=True)
                left = (x / peak / length) @ rotation(x.shape[1]).T
                bits, scales = [], []
                for _ in range(CODES):
                    bits.append(np.packbits(left > 0, axis=1))
                    scales.append(np.abs(left).mean(1))
                    left = left - np.where(left > 0, 1.0, -1.0) * scales[-1][:, None]
                code = pa.array([r.tobytes() for r in np.concatenate(bits, axis=1)], pa.binary())
                held = [code, pa.array(list(np.stack(scales, axis=1))), pa.array((peak * length).ravel()), pa.array(np.linalg.norm(left, axis=1))]
                yield pa.RecordBatch.from_arrays([b["id"], b["v"], *held], ["id", "v", "code", "scales", "norm", "rest"])

    return vectors.select("id", "v").mapInArrow(task, "id long, v array<double>, code binary, scales array<double>, norm double, rest double")


def _decoded(t: pa.Table, dim: int) -> np.ndarray:
    """The rotated unit vectors as far as their codes tell, in single precision."""
    scales = _matrix(t["scales"]).astype(np.float32)
    codes = np.frombuffer(b"".join(t["code"].to_pylist()), np.uint8).reshape(t.num_rows, CODES, -1)
    out = np.zeros((t.num_rows, dim), np.float32)
    for k in range(CODES):
        out += (np.unpackbits(codes[:, k], axis=1, count=dim).astype(np.float32) * 2 - 1) * scales[:, k, None]
    return out


def _products(x: np.ndarray, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of some rows with q, each summed alike, so that equal vectors have equal ones."""
    return np.concatenate([(x[rows[a : a + 8192]] * q).sum(1) for a in range(0, len(rows), 8192)]) if len(rows) else np.zeros(0)


def nearest(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest inner products over all other rows, ties to the smaller id.

    is_query is a condition on `id`; candidates are the rows of a query's own dimension. Rows and queries meet in cells of bounded size,
    large ones, since every row is sent once for each block of queries and every query once for each block of rows. A cell estimates all
    products from one-bit codes, reranks the best estimates, and then every vector that can reach the k-th exact product so far:
    a product is off its estimate by no more than the lengths of the query and of what the codes leave, so none is missed. Rows that cannot be compared (see usable) take no part; of rows
    with one id the smallest vector counts.
    """
    coded = checkpointed(encode(usable(vectors, id_col, vector).groupBy("id").agg(F.min("v").alias("v"))))
    total, asked = coded.count(), coded.where(is_query).count()
    row_blocks = max(1, -(-total // ROWS), min(partitions(vectors.sparkSession), -(-total // FEWEST)))
    query_blocks = max(1, -(-asked // QUERIES))
    h = F.xxhash64("id", F.lit(3))
    coded = coded.withColumn("d", F.size("v"))
    rows = coded.select("*", F.pmod(h, F.lit(row_blocks)).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("j"))
    queries = coded.where(is_query).select("id", "v", "d", F.pmod(h, F.lit(query_blocks)).cast("int").alias("j"), F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("i"))
    schema = "query_id long, vec_id long, score double"

    def search(key: tuple, left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
        if not left.num_rows or not right.num_rows:
            return
        ids, order = left["id"].to_numpy(), np.argsort(left["id"].to_numpy())
        ids, left = ids[order], left.take(pa.array(order))
        x, norm = _matrix(left["v"]), left["norm"].to_numpy()
        dim = x.shape[1]
        known = _decoded(left, dim)
        # What the codes leave, and the rounding of estimates in single precision.
        width = left["rest"].to_numpy() + 1e-6 + 1.2e-7 * dim
        q_ids, q = right["id"].to_numpy(), _matrix(right["v"])
        peak = np.abs(q).max(1, keepdims=True)
        length = np.linalg.norm(q / peak, axis=1, keepdims=True)
        turned = ((q / peak / length) @ rotation(dim).T).astype(np.float32)
        q_norm = (peak * length).ravel()
        out: list[list] = [[], [], []]
        for a in range(0, len(q_ids), 256):
            estimate = turned[a : a + 256] @ known.T
            for e, own, qv, size in zip(estimate, q_ids[a : a + 256], q[a : a + 256], q_norm[a : a + 256]):
                at = np.searchsorted(ids, own)
                own_row = at if at < len(ids) and ids[at] == own else -1
                e = e.astype(float)
                likely = e * norm
                if own_row >= 0:
                    likely[own_row] = -np.inf
                some = np.argpartition(-likely, 3 * k)[: 3 * k] if len(e) > 3 * k else np.arange(len(e))
                some = some[some != own_row]
                exact = _products(x, some, qv)
                floor = np.partition(exact, -k)[-k] if len(exact) > k else -np.inf
                chosen = np.union1d(np.flatnonzero((e + width) * norm * size >= floor), some)
                chosen = chosen[chosen != own_row]
                score = _products(x, chosen, qv)
                best = np.lexsort((ids[chosen], -score))[:k]
                out[0] += [own] * len(best)
                out[1] += ids[chosen[best]].tolist()
                out[2] += score[best].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    found = rows.groupBy("i", "j", "d").cogroup(queries.groupBy("i", "j", "d")).applyInArrow(cogrouped(search, schema), schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", F.row_number().over(best).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
