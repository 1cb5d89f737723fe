"""The k most similar vectors of every vector (problem 6): forests of projection trees searched through a shared priority queue, exact
reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import cut

#: Vectors that a cell should hold, not counting those that lie near its borders; the collection is cut into so many cells as that takes.
CELL = 8192
#: Vectors, at least and at most, on which the tree of cells is fitted, so many for each cell between (all vectors are indexed). Bounds
#: the driver and the broadcast.
SAMPLE, MOST_SAMPLE, PER_CELL = 8192, 65_536, 32
#: Levels of that tree, at most.
LEVELS = 20
#: Cells that a vector goes to, at most, and how far it may lie beyond a border (in units of its length) to go there too.
CELLS, SPILL = 4, 0.12
#: In a cell: trees, vectors in a leaf, and leaves that are searched for each vector, in the order in which one queue over all trees
#: hands them out.
TREES, LEAF, LEAVES = 4, 256, 14
#: Nodes up to which margins are computed for all nodes at once, rows that are searched at once, and pairs ranked at once.
DENSE, ROWS, PAIRS = 512, 2048, 8192


def _normal(seed: int, node: int, width: int) -> np.ndarray:
    n = np.random.default_rng((seed, node)).standard_normal(width).astype(np.float32)
    return n / np.linalg.norm(n)


@dataclass
class Forest:
    """Trees of one depth, their inner nodes in the order of a heap: normals (trees, nodes, width) of the first nodes, those of later
    ones follow from the seed; bounds (trees, inner nodes). members: the rows in each leaf, through all trees, if kept."""

    normals: np.ndarray
    bounds: np.ndarray
    depth: int
    seed: int
    members: list[np.ndarray]

    def normal(self, tree: int, node: int) -> np.ndarray:
        return self.normals[tree, node] if node < self.normals.shape[1] else _normal(self.seed, tree << 32 | node, self.normals.shape[2])

    def _margins(self, v: np.ndarray, tree: np.ndarray, node: np.ndarray) -> np.ndarray:
        known = self.normals.shape[1]
        if node.max() < known:
            n = self.normals[tree, node]
        else:
            kinds, at = np.unique(np.stack([tree, node]), axis=1, return_inverse=True)
            n = np.stack([self.normal(int(t), int(x)) for t, x in kinds.T])[at.ravel()]
        return np.einsum("ij,ij->i", v, n) - self.bounds[tree, node]

    def leaves(self, v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, priority), each (rows, most), of the leaves that a best-first search of all trees comes to first; -1 where there are
        no more. Leaves are numbered through all trees.

        One queue for each row holds subtrees of every tree. The one of highest priority is taken out and followed down to a leaf; the
        other side of every split on the way goes into the queue, with the smallest margin on the way to it as its priority: that is
        positive for a row's own leaves, and else says how far it lies beyond a border. All rows take their steps together.
        """
        rows, trees, depth = len(v), len(self.normals), self.depth
        inner = (1 << depth) - 1
        all_of = self.normals.reshape(-1, v.shape[1])
        dense = v @ all_of.T - self.bounds.ravel() if inner == self.normals.shape[1] and 0 < len(all_of) <= DENSE else None
        each = np.arange(rows)
        room = trees + most * depth
        prio = np.full((rows, room), -np.inf, np.float32)
        node, tree = np.zeros((rows, room), np.int32), np.zeros((rows, room), np.int32)
        prio[:, :trees], tree[:, :trees] = np.inf, np.arange(trees)
        leaf, far = np.full((rows, most), -1, np.int64), np.full((rows, most), -np.inf, np.float32)
        used = trees
        for k in range(most):
            at = prio[:, :used].argmax(1)
            p, cur, of = prio[each, at], node[each, at], tree[each, at]
            prio[each, at] = -np.inf
            for _ in range(depth):
                go = np.flatnonzero((cur < inner) & (p > -np.inf))
                if not len(go):
                    break
                m = dense[go, of[go] * inner + cur[go]] if dense is not None else self._margins(v[go], of[go], cur[go])
                side = (m <= 0).astype(np.int32)
                m = np.abs(m)
                node[go, used], tree[go, used], prio[go, used] = 2 * cur[go] + 2 - side, of[go], np.minimum(p[go], -m)
                p[go], cur[go] = np.minimum(p[go], m), 2 * cur[go] + 1 + side
                used += 1
            ok = p > -np.inf
            leaf[ok, k], far[ok, k] = of[ok].astype(np.int64) * (inner + 1) + cur[ok] - inner, p[ok]
        return leaf, far


def fit(x: np.ndarray, depth: int, trees: int, seed: int = 0, keep: bool = False) -> Forest:
    """A forest over unit vectors x.

    A node is split between two means of its vectors (two of them, moved a few times to the means of those nearest to them), at the
    median: halves of equal size whatever the density. Nodes of fewer than 8 vectors are split by random projections that follow from
    the seed, at the median of the vectors of the last node above that had some.
    """
    rng = np.random.default_rng(seed)
    width = x.shape[1] if x.ndim == 2 and len(x) else 1
    inner = (1 << depth) - 1
    known = min(inner, (1 << max(0, int(np.ceil(np.log2(max(1, len(x)) / 4))))) - 1)
    normals, bounds = np.zeros((trees, known, width), np.float32), np.zeros((trees, inner), np.float32)
    members: list[np.ndarray] = []
    for t in range(trees):
        own = {0: (np.arange(len(x)), np.arange(len(x)))}
        for node in range(inner):
            at, above = own.pop(node)
            n = _normal(seed, t << 32 | node, width)
            if len(at) >= 8 and node < known:
                part = x[rng.choice(at, min(len(at), 256), replace=False)]
                c = part[:2]
                for _ in range(4):
                    side = part @ c[0] > part @ c[1]
                    if side.all() or not side.any():
                        break
                    c = np.stack([part[side].mean(0), part[~side].mean(0)])
                    c /= np.linalg.norm(c, axis=1, keepdims=True) + 1e-12
                d = c[0] - c[1]
                if np.abs(d).max() > 1e-6:
                    n = d / np.linalg.norm(d)
            if node < known:
                normals[t, node] = n
            m = x[at] @ n
            bounds[t, node] = np.median(m) if len(at) > 3 else np.median(x[above[:256]] @ n) if len(above) else 0.0
            up = m > bounds[t, node]
            if keep and len(at) > 1 and (up.all() or not up.any()):  # equal projections: any halves, both sides being at the border
                up = np.arange(len(at)) % 2 == 0
            for child, side in ((2 * node + 1, at[up]), (2 * node + 2, at[~up])):
                own[child] = (side, side if len(side) > 3 else above)
        members += [own[inner + i][0] for i in range(inner + 1)] if keep else []
    return Forest(normals, bounds, depth, seed, members)


_NEAR = pa.struct([("far", pa.float64()), ("id", pa.int64())])


def _unit(v: np.ndarray) -> np.ndarray:
    big = np.abs(v).max(axis=1, keepdims=True)
    v = v / np.where(big > 0, big, 1)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)


def _packed(v: np.ndarray) -> bytes:
    """Vectors in single precision, without loss: first bytes of all numbers, second bytes and so on, compressed."""
    planes = np.ascontiguousarray(v, "<f4").view(np.uint8).reshape(-1, 4).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def _unpacked(b: bytes, count: int, width: int) -> np.ndarray:
    raw = pa.decompress(b, decompressed_size=count * width * 4, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<f4").reshape(count, width)


def _slack(width: int) -> float:
    """How far apart, in single precision, cosines may be that are equal after rounding to 6 decimals: the rounding step, and twice the
    error of a product of two unit vectors if all rounding errors of it and of their norms added up."""
    return 1.001e-6 + 2 * (3 * width + 16) * 2.0**-24


def search(v: np.ndarray, ids: np.ndarray, k: int, trees: int = TREES, leaf: int = LEAF, leaves: int = LEAVES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, cosine) of the k nearest rows of v of each row, as far as a forest over v finds them, in order.

    The vectors of the leaves that the queue hands out are the candidates. Single precision leaves out what is too far from the k-th to
    tie with it; double precision, rounded to 6 decimals, ranks the rest, ties by smaller id. Up to `leaf` vectors are compared all.
    """
    u, n = _unit(v), len(v)
    depth = int(np.ceil(np.log2(n / leaf))) if n > leaf else 0
    forest = fit(u, depth, trees if depth else 1, keep=True)
    visit = np.concatenate([forest.leaves(u[lo : lo + ROWS], leaves if depth else 1)[0] for lo in range(0, n, ROWS)]).ravel() if n else np.zeros(0, np.int64)
    q = np.repeat(np.arange(n), len(visit) // max(1, n))
    q, visit = q[visit >= 0], visit[visit >= 0]
    order = np.argsort(visit, kind="stable")
    q, starts = q[order], np.searchsorted(visit[order], np.arange(len(forest.members) + 1))
    slack = _slack(v.shape[1])
    got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at, own in enumerate(forest.members):
        for lo in range(starts[at], starts[at + 1], ROWS):
            asked = q[lo : min(lo + ROWS, starts[at + 1])]
            s = u[asked] @ u[own].T
            s[asked[:, None] == own[None, :]] = -9
            m = min(k, len(own))
            least = np.partition(s, len(own) - m, axis=1)[:, len(own) - m] - slack
            r, c = np.nonzero((s >= least[:, None]) & (s > -9))
            got.append((asked[r], own[c], s[r, c]))
    row, col, s = (np.concatenate(x) for x in zip(*got)) if got else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
    _, once = np.unique(row * np.int64(max(1, n)) + col, return_index=True)
    row, col, s = row[once], col[once], s[once]
    order = np.lexsort((-s, row))
    row, col, s = row[order], col[order], s[order]
    first = np.searchsorted(row, row)
    last = np.searchsorted(row, row, side="right") - 1
    ok = s >= s[np.minimum(first + k - 1, last)] - slack
    row, col = row[ok], col[ok]
    norm = np.sqrt(np.concatenate([(v[lo : lo + ROWS].astype(np.float64) ** 2).sum(1) for lo in range(0, n, ROWS)])) if n else np.zeros(0)
    cos = np.empty(len(row))
    for lo in range(0, len(row), PAIRS):
        a, b = row[lo : lo + PAIRS], col[lo : lo + PAIRS]
        cos[lo : lo + PAIRS] = (v[a].astype(np.float64) * v[b]).sum(1) / (norm[a] * norm[b])
    cos = np.round(cos, 6)
    order = np.lexsort((ids[col], -cos, row))
    row, col, cos = row[order], col[order], cos[order]
    ok = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[ok], ids[col[ok]], cos[ok]


def encoded(rows: DataFrame, width: int) -> DataFrame:
    """(id, updated_at, hi, lo, code) of rows (id, vector, updated_at): the vector, packed, and a digest of its direction in two halves;
    these are null where it hasn't exactly `width` finite numbers, not all zero. Rows without id are left out."""

    def of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            column = b.column("vector")
            good = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), width), False).to_numpy(zero_copy_only=False))
            v = column.take(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, width)
            fine = np.isfinite(v).all(1) & (v != 0).any(1)
            good, v = good[fine], v[fine]
            # quotients in double precision are the same for vectors in proportion; + 0.0 makes -0.0 of them 0.0
            way = v.astype(np.float64)
            way = way / np.abs(way).max(axis=1, keepdims=True) + 0.0 if len(way) else way
            code, hi, lo = [None] * b.num_rows, [None] * b.num_rows, [None] * b.num_rows
            for i, x, w in zip(good.tolist(), v, way):
                d = xxhash.xxh3_128_digest(w.tobytes())
                code[i], hi[i], lo[i] = _packed(x), int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("at"), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(code, pa.binary())], names=["id", "at", "hi", "lo", "code"])

    when = F.unix_micros(F.col("updated_at").cast("timestamp")) if dict(rows.dtypes).get("updated_at", "").startswith("timestamp") else F.col("updated_at").cast("long") if "updated_at" in rows.columns else F.lit(None).cast("long")
    return rows.where("id IS NOT NULL").select(F.col("id").cast("long").alias("id"), when.alias("at"), F.col("vector").cast("array<float>").alias("vector")).mapInArrow(of, "id long, at long, hi long, lo long, code binary")


def nearest(vectors: DataFrame, k: int = 5, width: int = 384, cell: int = CELL, cells: int = CELLS, spill: float = SPILL, trees: int = TREES, leaf: int = LEAF, leaves: int = LEAVES, seed: int = 0) -> DataFrame:
    """(id, neighbour, cosine, rank): the k most similar other vectors of every vector, as far as the forests find them.

    vectors: id, vector and, if ids repeat, updated_at: of each id the latest row counts (null times come first; of rows of one time any
    usable one); it is left out if its vector hasn't exactly `width` finite numbers, not all zero. Further columns are ignored.

    1. Vectors of equal direction are collapsed, each with the k + 1 smallest of their ids, so any number of copies takes one place;
    only digests are shuffled for that. 2. A tree fitted on a bounded sample cuts the collection into cells of about `cell` vectors; a
    vector goes, packed, to its own cell and to those whose border it is near, `cells` at most. 3. In each cell, forests over all its
    vectors are searched through one queue for each vector; candidates are ranked exactly (see search). A cell that the sample shows to
    be very large is searched in blocks, each pair of blocks in a task of its own. Cosines are in double precision, rounded to 6
    decimals, ties by smaller id. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = cut(encoded(vectors, width))
    last = rows.select("id", "at", "hi", "lo").groupBy("id").agg(F.max(F.struct("at", "hi", "lo")).alias("r")).where("r.hi IS NOT NULL").select("id", "r.hi", "r.lo")
    last = cut(last)
    classes = cut(last.groupBy("hi", "lo").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    same = cut(last.join(classes.where("copies > 1").select("hi", "lo", "rep"), ["hi", "lo"]).select("rep", "id"))
    first = same.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("r") <= k + 1)
    least = cut(first.groupBy("rep").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    count = classes.count()
    depth = min(LEVELS, max(0, int(np.ceil(np.log2(max(1, count) / cell)))))
    want = min(MOST_SAMPLE, max(SAMPLE, PER_CELL << depth)) if depth else 0
    share = min(1.0, 1.2 * want / max(1, count))
    picked = rows.where("code IS NOT NULL").select("code", F.xxhash64(F.lit(seed), "hi", "lo").alias("o")).where(F.pmod("o", F.lit(1 << 20)) < share * (1 << 20)).orderBy("o").limit(want).toArrow() if depth else None
    sample = _unit(np.concatenate([_unpacked(x, 1, width) for x in picked["code"].to_pylist()])) if depth and picked.num_rows else np.zeros((0, width), np.float32)
    tree = fit(sample, depth, 1, seed)
    crowd: dict[int, int] = {}
    if len(sample):
        at, far = (np.concatenate(x) for x in zip(*(tree.leaves(sample[lo : lo + ROWS], cells) for lo in range(0, len(sample), ROWS))))
        size = np.bincount(at[(at >= 0) & (far >= -spill)], minlength=1 << depth) * (count / len(sample))
        crowd = {int(c): int(-(-size[c] // (2 * cell))) for c in np.flatnonzero(size > 8 * cell)}
    shared = spark.sparkContext.broadcast((tree, crowd))

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, crowd = shared.value
        for b in it:
            ids = b.column("rep").to_numpy()
            v = np.concatenate([_unpacked(x, 1, width) for x in b.column("code").to_pylist()]) if len(ids) else np.zeros((0, width), np.float32)
            u, out = _unit(v) if len(v) else v, []
            for lo in range(0, len(v), ROWS):
                at, far = tree.leaves(u[lo : lo + ROWS], cells if tree.depth else 1)
                for c in np.unique(at[at >= 0]).tolist():
                    mine = lo + np.flatnonzero(((at == c) & (far >= -spill)).any(1))
                    n = crowd.get(c, 1)
                    block = (ids[mine].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % n
                    for x in np.unique(block).tolist():
                        part = mine[block == x]
                        if len(part):
                            packed = _packed(v[part])
                            out += [(c, min(x, y), max(x, y), ids[part].tolist(), packed) for y in (range(n) if n > 1 else [0]) if n == 1 or y != x]
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary()))], names=["cell", "i", "j", "reps", "code"])

    def of(key: tuple, group: pa.Table) -> pa.Table:
        reps = [np.array(x, np.int64) for x in group.column("reps").to_pylist()]
        v = np.concatenate([_unpacked(c, len(r), width) for c, r in zip(group.column("code").to_pylist(), reps)])
        ids = np.concatenate(reps)
        row, near, cos = search(v, ids, k, trees, leaf, leaves)
        ends = np.searchsorted(row, np.arange(len(ids) + 1)).astype(np.int32)
        flat = pa.StructArray.from_arrays([pa.array(-cos), pa.array(near, pa.int64())], names=["far", "id"])
        return pa.table({"rep": pa.array(ids), "near": pa.ListArray.from_arrays(pa.array(ends), flat)})

    held = rows.where("code IS NOT NULL").groupBy("hi", "lo").agg(F.first("code").alias("code")).join(classes.select("hi", "lo", "rep"), ["hi", "lo"]).select("rep", "code")
    placed = held.mapInArrow(place, "cell long, i int, j int, reps array<long>, code binary")
    found = placed.groupBy("cell", "i", "j").applyInArrow(of, "rep long, near array<struct<far:double,id:long>>")
    # at most k for each of a vector's cells and blocks
    best = cut(found.groupBy("rep").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k).alias("near")))
    return _with_copies(best, classes, same, least, k)


def _with_copies(best: DataFrame, classes: DataFrame, same: DataFrame, least: DataFrame, k: int) -> DataFrame:
    """The neighbours of all ids from those of the representatives; copies are each other's nearest."""
    near = best.select("rep", F.explode("near").alias("x")).select("rep", F.col("x.id").alias("other"), F.col("x.far").alias("far"))
    near = near.join(least.select(F.col("rep").alias("other"), "ids"), "other", "left").select("rep", "far", F.explode(F.coalesce("ids", F.array("other"))).alias("neighbour"))
    own = least.select("rep", F.lit(-1.0).alias("far"), F.explode("ids").alias("neighbour"))
    ids = classes.where("copies = 1").select("rep", F.col("rep").alias("id")).unionByName(same)
    ranked = ids.join(near.unionByName(own), "rep").where("id <> neighbour").withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("far", "neighbour")))
    return ranked.where(F.col("rank") <= k).select("id", "neighbour", (-F.col("far")).alias("cosine"), "rank")
