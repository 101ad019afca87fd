"""Most similar vectors for every vector: a forest of random-projection trees.

Per space (table and model) a forest of complete binary trees is fitted on a
bounded sample of all spaces together (``SAMPLE_ROWS`` vectors, by hash): every
node projects on the difference of two of its own sample points and splits at
the median. The number of leaves follows the number of vectors, ``LEAF_ROWS``
to a leaf, as far as the sample can carry it; a leaf that holds more is split
further where it is searched, by trees with pivots from its own rows, so the
depth grows with the logarithm of the collection and the work of one search
does not grow with it. Every vector is indexed in one leaf of each tree and
searched in the best leaves of all trees (``TREES`` plus the depth), taken from
one shared priority order: a leaf's priority is the least signed margin on its
path. Searches meet the index rows leaf by leaf.

Vectors travel to the leaves as eight-bit codes with their scale and the exact
length of their rounding error, so candidates are kept whenever the error
bound lets them be among the k best; these few are then ranked by the exact
cosines of the stored vectors.

Leaves of a median split hold equal shares of the sample, so no cluster makes
a hot leaf; exact copies, which no split can part, are one vector in the
search and are expanded afterwards (each copy's neighbours are then the copies
of smallest id). A leaf with more than ``BLOCK_ROWS`` index rows is searched in
blocks. Only trees (bounded by the sample) are sent to the workers.

Vectors that are null, of the wrong length, all zero or hold null, NaN or
infinite numbers take no part. Ties in similarity go to the smaller id.
Redelivered rows count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.session import cut_lineage

#: Vectors of all spaces the forests are fitted on.
SAMPLE_ROWS = 65_536
LEAF_SAMPLE = 16
LEAF_ROWS = 2_048
TREES = 4
#: Index rows of a leaf that one task takes.
BLOCK_ROWS = 65_536
BATCH = 512
#: Candidate pairs up to which they are sent to the vectors instead of the
#: vectors being shuffled (48 bytes each).
BROADCAST_PAIRS = 500_000
_HASH_RANGE = 1 << 30


def sound(data: Column, length: Column) -> Column:
    """Vector of the right length without null, NaN or infinity, not all zero."""
    bad = F.exists(data, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(
        (F.size(data) == length) & ~bad & F.exists(data, lambda x: x != 0), F.lit(False)
    )


class Forest:
    """Complete random-projection trees over unit vectors, ``depth`` levels each."""

    def __init__(self, points: np.ndarray, depth: int, trees: int = TREES, seed: int = 7):
        n, d = points.shape
        self.depth, self.trees, self.leaves = depth, trees, 1 << depth
        self.normals = np.zeros((trees, self.leaves - 1, d), np.float32)
        self.offsets = np.zeros((trees, self.leaves - 1), np.float32)
        #: leaf of every point in each tree
        self.home = np.zeros((n, trees), np.int64)
        rng = np.random.default_rng(seed)
        for t in range(trees):
            groups = [np.arange(n)]
            for level in range(depth):
                below = []
                for i, g in enumerate(groups):
                    a, b = rng.choice(g, 2, replace=False)
                    normal = points[a] - points[b]
                    size = np.linalg.norm(normal)
                    if size < 1e-6:
                        normal, size = rng.standard_normal(d), np.sqrt(d)
                    normal = (normal / size).astype(np.float32)
                    proj = points[g] @ normal
                    order = np.argsort(proj, kind="stable")
                    half = len(g) // 2
                    node = (1 << level) - 1 + i
                    self.normals[t, node] = normal
                    self.offsets[t, node] = (proj[order[half - 1]] + proj[order[half]]) / 2
                    below += [g[order[:half]], g[order[half:]]]
                groups = below
            for i, g in enumerate(groups):
                self.home[g, t] = i + t * self.leaves

    def priorities(self, x: np.ndarray) -> np.ndarray:
        """rows x (trees * leaves): least signed margin on each leaf's path."""
        rows = len(x)
        out = np.empty((rows, self.trees, self.leaves), np.float32)
        for t in range(self.trees):
            margin = x @ self.normals[t].T - self.offsets[t]
            prio = np.full((rows, 1), np.inf, np.float32)
            for level in range(self.depth):
                m = margin[:, (1 << level) - 1: (1 << (level + 1)) - 1]
                pair = np.empty((rows, 2 << level), np.float32)
                pair[:, 0::2] = np.minimum(prio, -m)
                pair[:, 1::2] = np.minimum(prio, m)
                prio = pair
            out[:, t] = prio
        return out.reshape(rows, -1)

    def route(self, x: np.ndarray) -> np.ndarray:
        """rows x leaves: 1 where the vector is indexed, 2 where it is searched."""
        prio = self.priorities(x)
        own = prio.reshape(len(x), self.trees, -1).argmax(axis=2) + np.arange(self.trees) * self.leaves
        role = np.zeros(prio.shape, np.int8)
        np.put_along_axis(role, own, 1, axis=1)
        best = best_leaves(prio, self.trees + self.depth)
        np.put_along_axis(role, best, np.take_along_axis(role, best, axis=1) + 2, axis=1)
        return role


def best_leaves(prio: np.ndarray, visits: int) -> np.ndarray:
    """The leaves of highest priority of each row, all trees in one order."""
    if visits >= prio.shape[1]:
        return np.tile(np.arange(prio.shape[1]), (len(prio), 1))
    return np.argpartition(-prio, visits - 1, axis=1)[:, :visits]


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows of a list column whose lists are of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    x = flat.reshape(len(column), -1)
    return x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True).astype(np.float32)


def encode(x: np.ndarray) -> np.ndarray:
    """Scale, length of the rounding error and eight-bit code of each row."""
    scale = np.abs(x).max(axis=1).astype(np.float32) / np.float32(127)
    code = np.rint(x / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(x - code * scale[:, None], axis=1).astype(np.float32)
    return np.concatenate([scale[:, None].view(np.int8), error[:, None].view(np.int8), code], axis=1)


def _binary(blob: np.ndarray) -> pa.Array:
    offsets = (np.arange(len(blob) + 1) * blob.shape[1]).astype(np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(blob), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(blob))]
    )


def decode(codes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the codes and the lengths of their errors."""
    raw = np.frombuffer(b"".join(codes.to_pylist()), np.int8).reshape(len(codes), -1)
    head = np.ascontiguousarray(raw[:, :8]).view(np.float32)
    return raw[:, 8:].astype(np.float32) * head[:, :1], head[:, 1]


def fit_forests(classes: DataFrame) -> tuple[dict[str, Forest], float]:
    """Forests of the spaces with more than one leaf, and the sampled share."""
    total = classes.count()
    share = min(1.0, SAMPLE_ROWS / max(1, total))
    sample = (
        classes.where(F.pmod(F.xxhash64("h", F.lit(1)), F.lit(_HASH_RANGE)) < int(share * _HASH_RANGE) + 1)
        .select("space", "h", "data").limit(2 * SAMPLE_ROWS).toArrow().combine_chunks().sort_by("h")
    )
    forests = {}
    for space in sample.column("space").unique().to_pylist():
        data = sample.filter(pc.equal(sample.column("space"), space)).column("data").combine_chunks()
        wanted = np.log2(max(1.0, len(data) / share / LEAF_ROWS))
        depth = int(min(np.ceil(wanted), np.log2(max(1, len(data) // LEAF_SAMPLE))))
        if depth > 0:
            forest = Forest(_matrix(data), depth)
            forest.home = None
            forest.leaf_rows = len(data) / share / forest.leaves
            forests[space] = forest
    return forests, share


def leaf_search(base: np.ndarray, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks (query rows, base rows) that meet in one leaf: the leaf itself, or
    the leaves of a tree with pivots from its own rows."""
    depth = max(0, int(np.ceil(np.log2(max(1, len(base)) / LEAF_ROWS))))
    if depth == 0:
        every = np.arange(len(base))
        for lo in range(0, len(queries), 1024):
            yield np.arange(lo, min(lo + 1024, len(queries))), every
        return
    tree = Forest(base, depth, trees=2)
    visited = [[] for _ in range(tree.trees * tree.leaves)]
    for lo in range(0, len(queries), BATCH):
        best = best_leaves(tree.priorities(queries[lo:lo + BATCH]), tree.trees + depth)
        rows = np.repeat(np.arange(lo, lo + len(best)), best.shape[1])
        order = np.argsort(best.ravel(), kind="stable")
        leaf, rows = best.ravel()[order], rows[order]
        cut = np.flatnonzero(np.diff(leaf)) + 1
        for name, part in zip(leaf[np.r_[0, cut]], np.split(rows, cut)):
            visited[name].append(part)
    for leaf, parts in enumerate(visited):
        if parts:
            inside = np.flatnonzero((tree.home == leaf).any(axis=1))
            rows = np.concatenate(parts)
            for lo in range(0, len(rows), 1024):
                yield rows[lo:lo + 1024], inside


def nearest(vectors: DataFrame, k: int = 5, min_cosine: float = -1.0) -> DataFrame:
    """space, id, other, cosine: the ``k`` most similar vectors of every vector
    among those of at least ``min_cosine``.

    ``vectors`` has space (string), id (long) and sound data."""
    rows = vectors.select("space", F.col("id").cast("long").alias("id"), "data").withColumn(
        "h", F.xxhash64("space", "data")
    ).withColumn("h2", F.hash("data", F.lit(3)))
    classes = cut_lineage(
        rows.groupBy("space", "h", "h2").agg(F.first("data").alias("data"), F.count(F.lit(1)).alias("n"))
    ).withColumn("cls", F.monotonically_increasing_id())
    forests, share = fit_forests(classes)
    names = ["space", "leaf", "cls", "role", "code"]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spaces = batch.column("space").to_numpy(zero_copy_only=False)
            cls = batch.column("cls").to_numpy(zero_copy_only=False)
            for space in np.unique(spaces):
                at = np.flatnonzero(spaces == space)
                for lo in range(0, len(at), BATCH):
                    mine = at[lo:lo + BATCH]
                    x = _matrix(batch.column("data").take(pa.array(mine)))
                    forest = forests.get(space)
                    role = np.full((len(x), 1), 3, np.int8) if forest is None else forest.route(x)
                    row, leaf = np.nonzero(role)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(row), space, object)), pa.array(leaf.astype(np.int32)),
                            pa.array(cls[mine][row]), pa.array(role[row, leaf]), _binary(encode(x)[row]),
                        ],
                        names=names,
                    )

    routed = classes.select("space", "cls", "data").mapInArrow(
        spread, "space string, leaf int, cls long, role tinyint, code binary"
    )
    # a space without a forest has fewer than 2 * LEAF_SAMPLE rows in the sample
    blocks = {s: -(-f.leaf_rows // BLOCK_ROWS) for s, f in forests.items()}
    other = max(1, int(4 * LEAF_SAMPLE / share) // BLOCK_ROWS)
    if other > 1 or any(b > 1 for b in blocks.values()):
        n_blocks = F.coalesce(*[F.when(F.col("space") == s, F.lit(int(b))) for s, b in blocks.items()], F.lit(other))
        mine = F.pmod(F.xxhash64("cls"), n_blocks)
        routed = routed.withColumn("block", F.explode(F.sequence(F.lit(0), n_blocks - 1))).withColumn(
            "role", F.when(F.col("block") == mine, F.col("role")).otherwise(F.col("role").bitwiseAND(2)).cast("tinyint")
        ).where("role > 0")
    else:
        routed = routed.withColumn("block", F.lit(0))

    def candidates(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        role = group.column("role").to_numpy()
        cls = group.column("cls").to_numpy()
        index, search = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
        out = [[], [], [], []]
        if len(index) and len(search):
            x, error = decode(group.column("code").chunk(0))
            base, base_cls, slack = x[index], cls[index], 2 * error.max() + error.max() ** 2
            x, query_cls = x[search], cls[search]
            for q, b in leaf_search(base, x):
                cos = x[q] @ base[b].T
                cos[query_cls[q][:, None] == base_cls[b][None, :]] = -2.0
                keep = min(k, cos.shape[1])
                kth = np.partition(cos, cos.shape[1] - keep, axis=1)[:, cos.shape[1] - keep]
                # whatever may be among the k best within the error of the codes
                floor = np.maximum(kth - 2 * slack, min_cosine - slack)
                qi, oi = np.nonzero((cos >= floor[:, None]) & (cos > -1.5))
                for column, value in zip(out, (query_cls[q][qi], base_cls[b][oi], cos[qi, oi], np.full(len(qi), slack))):
                    column.append(value)
        cells = [np.concatenate(c) if c else np.empty(0) for c in out]
        return pa.table(
            {
                "space": pa.array(np.full(len(cells[0]), group.column("space")[0].as_py(), object), pa.string()),
                "cls": pa.array(cells[0], pa.int64()), "other_cls": pa.array(cells[1], pa.int64()),
                "near": pa.array(cells[2], pa.float32()), "slack": pa.array(cells[3], pa.float32()),
            }
        )

    of_class = Window.partitionBy("space", "cls")
    found = cut_lineage(
        routed.groupBy("space", "leaf", "block")
        .applyInArrow(candidates, "space string, cls long, other_cls long, near float, slack float")
        .groupBy("space", "cls", "other_cls")
        .agg(F.max("near").alias("near"), F.max("slack").alias("slack"))
        .withColumn("rn", F.row_number().over(of_class.orderBy(F.desc("near"))))
        .withColumn("kth", F.min(F.when(F.col("rn") <= k, F.col("near"))).over(of_class))
        .where(F.col("near") >= F.col("kth") - 2 * F.col("slack"))
        .select("space", "cls", "other_cls")
    )
    found = _exact(found, classes).where(F.col("cosine") >= min_cosine)
    # members: all of a class search; the k + 1 of smallest id stand for it as neighbours
    member = rows.select("space", "h", "h2", "id").distinct().join(
        classes.select("space", "h", "h2", "cls", "n"), ["space", "h", "h2"]
    ).select("space", "cls", "id", "n")
    by_id = Window.partitionBy("space", "cls", "salt").orderBy("id")
    heads = (
        member.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
        .withColumn("rn", F.row_number().over(by_id))
        .where(F.col("rn") <= k + 1)
        .withColumn("rn", F.row_number().over(Window.partitionBy("space", "cls").orderBy("id")))
        .where(F.col("rn") <= k + 1)
        .select("space", F.col("cls").alias("other_cls"), F.col("id").alias("other"))
    )
    best = (
        found.withColumn("rk", F.rank().over(of_class.orderBy(F.desc("cosine"))))
        .where(F.col("rk") <= k)
        .drop("rk")
    )
    copies = member.where("n > 1").select("space", "id", F.col("cls").alias("other_cls"), F.lit(1.0).alias("cosine"))
    others = member.join(best, ["space", "cls"]).select("space", "id", "other_cls", "cosine")
    pairs = (
        copies.unionByName(others)
        .join(heads, ["space", "other_cls"])
        .where(F.col("id") != F.col("other"))
        .select("space", "id", "other", "cosine")
    )
    order = Window.partitionBy("space", "id").orderBy(F.desc("cosine"), "other")
    return (
        pairs.where(F.col("cosine") >= min_cosine)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
    )


def _exact(found: DataFrame, classes: DataFrame) -> DataFrame:
    """space, cls, other_cls, cosine of candidate pairs from the stored vectors.

    Few pairs are sent to the vectors; many meet them in shuffled joins."""
    few = found.count() <= BROADCAST_PAIRS
    pairs = F.broadcast(found) if few else found
    left = classes.select("cls", F.col("data").alias("x")).join(pairs, "cls")
    right = classes.select(F.col("cls").alias("other_cls"), F.col("data").alias("y")).join(
        pairs.select("cls", "other_cls"), "other_cls"
    )

    def dot(a: str, b: str) -> Column:
        products = F.zip_with(a, b, lambda u, v: u.cast("double") * v.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)

    return left.join(right, ["cls", "other_cls"]).select(
        "space", "cls", "other_cls", (dot("x", "y") / F.sqrt(dot("x", "x") * dot("y", "y"))).alias("cosine")
    )
