"""Exact k-nearest neighbours inside each class, without forming all pairs.

Used by SMOTE (the neighbour search inside a class) and exposed as its own
operator.  Distances are Euclidean on ``array<double>`` features.

Plan
----
1. Points are cut into cells of a k-d tree, about ``CELL`` of ``block_rows`` points each: a sample of bounded size gives the planes (it decides
   where blocks end, nothing else), and every point walks down to its cell.  Cells are numbered in the tree's order, so neighbours
   in space are mostly neighbours in number.
2. A cell that is still too large (a hot value holding a third of a class) is split further by a hash into sub-blocks,
   so no task ever holds more than ~``block_rows`` points of one block.  Up to ``4 * block_rows`` points there is no tree: buckets of the
   first coordinate serve as cells.
3. Pass 1, per block (``applyInPandas``): exact k nearest inside the block, which
   also gives every point an upper bound r_q on its k-th distance.
4. Pass 2: a point only asks the cells of its label whose bounding box is within r_q of it (the box of ``GROUP`` cells in a row is looked
   at first).  A run of such cells is one request, and a wide block (``WIDE`` cells in a row) meets its requests in one task, ``WIDE * block_rows`` of
   them at most.  Each (wide block, its askers) group is scored in ``cogroup().applyInPandas``, over the asked cells only, and returns
   at most k candidates per request.  One matrix product leaves out the pairs that are surely too far; the others are measured exactly.
5. Candidates from both passes are merged: the k smallest (distance, id) per point.

Only k candidates per (point, block) are ever emitted; pairs are scored inside a
task and discarded.  The result is exact: every point that could be closer than
the current k-th neighbour lies in a cell that was asked.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# The pandas functions below run on executors.  Pickle this module's helpers by value with the
# UDFs, so executors do not need the package installed or on their path.
try:
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: the package must then be shipped (--py-files)
    pass

DEFAULT_BLOCK_ROWS = 1024
WIDE = 8
GROUP = 32
#: Points of a cell, as a share of ``block_rows``: cells vary in size, few should need sub-blocks.
CELL = 0.6
#: Of the sample that the planes are taken from: points for a cell, and numbers at most.
SAMPLE_POINTS, SAMPLE_NUMBERS = 32, 1 << 22
_CHUNK = 128
# block tables (one row per block) are broadcast only below this many rows; above it they are
# joined normally (n / block_rows grows with the data, so the bound is checked, not assumed)
MAX_BROADCAST_BLOCKS = 1_000_000


def _sq_dists(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, summed dimension by dimension in order (stable across engines)."""
    out = np.zeros((a.shape[0], b.shape[0]), dtype=np.float64)
    for j in range(a.shape[1]):
        d = a[:, j, None] - b[None, :, j]
        out += d * d
    return out


def _top_k(qids, qvecs, pids, pvecs, k, exclude_self, limits=None, blocks=None):
    """For each query: up to k (dist, id) pairs, smallest first (ties by id).

    ``blocks``: (queries' first and last bucket, queries' own block, points' buckets, points' blocks): a query asks the points of
    its buckets but for those of its own block; points ascend by bucket."""
    if blocks is not None:
        lo, hi, own, bucket, block = blocks
        order = np.argsort(lo, kind="stable")
        res_ids, res_d = [None] * len(qids), [None] * len(qids)
        for s in range(0, len(order), _CHUNK):
            at = order[s:s + _CHUNK]
            a, z = np.searchsorted(bucket, lo[at].min()), np.searchsorted(bucket, hi[at].max(), side="right")
            b = bucket[None, a:z]
            asked = (b >= lo[at, None]) & (b <= hi[at, None]) & (block[None, a:z] != own[at, None])
            ids, ds = _nearest(qids[at], qvecs[at], pids[a:z], pvecs[a:z], k, exclude_self, limits[at], asked)
            for i, x, d in zip(at, ids, ds):
                res_ids[i], res_d[i] = x, d
        return res_ids, res_d
    return _nearest(qids, qvecs, pids, pvecs, k, exclude_self, limits)


def _nearest(qids, qvecs, pids, pvecs, k, exclude_self, limits=None, asked=None):
    res_ids, res_d = [], []
    pids = np.asarray(pids)
    qids = np.asarray(qids)
    n_p = len(pids)
    if n_p == 0:
        return [[] for _ in qids], [[] for _ in qids]
    kk = min(k, n_p)
    if limits is not None and len(qids):
        return _nearest_within(qids, qvecs, pids, pvecs, k, exclude_self, np.asarray(limits, np.float64), asked)
    for s in range(0, len(qids), _CHUNK):
        d = np.sqrt(_sq_dists(qvecs[s:s + _CHUNK], pvecs))  # (m, n_p)
        m = d.shape[0]
        valid = np.ones_like(d, dtype=bool) if asked is None else asked[s:s + m].copy()
        if exclude_self:
            valid &= qids[s:s + m, None] != pids[None, :]
        dm = np.where(valid, d, np.inf)
        kth = np.partition(dm, kk - 1, axis=1)[:, kk - 1]
        # candidates up to the k-th distance (ties included), then exact (row, dist, id) order
        r, c = np.nonzero(valid & (dm <= kth[:, None]))
        order = np.lexsort((pids[c], d[r, c], r))
        r, c = r[order], c[order]
        rank = np.arange(len(r)) - np.searchsorted(r, np.arange(m))[r]
        keep = rank < k
        r, c = r[keep], c[keep]
        cuts = np.cumsum(np.bincount(r, minlength=m))[:-1]
        res_ids.extend(x.tolist() for x in np.split(pids[c], cuts))
        res_d.extend(x.tolist() for x in np.split(d[r, c], cuts))
    return res_ids, res_d


def _nearest_within(qids, qvecs, pids, pvecs, k, exclude_self, limits, asked=None):
    """``_nearest`` up to a distance for each query: pairs that a matrix product shows to be farther are not measured."""
    res_ids, res_d, p_sq = [], [], (pvecs**2).sum(axis=1)
    for s in range(0, len(qids), _CHUNK):
        q, limit = qvecs[s:s + _CHUNK], limits[s:s + _CHUNK]
        m, norms = len(q), (q**2).sum(axis=1)[:, None] + p_sq
        # the product's error is far below this share of the norms
        valid = ~(norms - 2 * (q @ pvecs.T) > (limit**2 * (1 + 1e-9))[:, None] + 1e-11 * norms)
        if asked is not None:
            valid &= asked[s:s + m]
        if exclude_self:
            valid &= qids[s:s + m, None] != pids[None, :]
        r, c = np.nonzero(valid)
        d = np.zeros(len(r))
        for j in range(q.shape[1]):  # in the order of ``_sq_dists``
            one = q[r, j] - pvecs[c, j]
            d += one * one
        d = np.sqrt(d)
        near = d <= limit[r]
        r, c, d = r[near], c[near], d[near]
        order = np.lexsort((pids[c], d, r))
        r, c, d = r[order], c[order], d[order]
        keep = np.arange(len(r)) - np.searchsorted(r, np.arange(m))[r] < k
        r, c, d = r[keep], c[keep], d[keep]
        cuts = np.cumsum(np.bincount(r, minlength=m))[:-1]
        res_ids.extend(x.tolist() for x in np.split(pids[c], cuts))
        res_d.extend(x.tolist() for x in np.split(d, cuts))
    return res_ids, res_d


def _planes(sample: np.ndarray, cells: int) -> tuple:
    """A k-d tree over the sample's axes of most spread: ``axis`` (-1 at leaves), ``cut`` (up to it a point goes left), ``left`` (the right child
    follows), ``cell`` (number of a leaf in the tree's order)."""
    axis, cut, left, cell = [-1], [0.0], [-1], [-1]
    count = 0

    def grow(node, rows, cells):
        nonlocal count
        if cells > 1 and len(rows) > 1:
            x = sample[rows]
            for a in np.argsort(-x.var(axis=0), kind="stable"):
                v = np.sort(x[:, a])
                if not v[0] < v[-1]:
                    break
                half = cells // 2
                at = v[min(len(v) - 1, len(v) * half // cells)]
                at = at if at < v[-1] else v[np.searchsorted(v, v[-1]) - 1]
                low = x[:, a] <= at
                axis[node], cut[node], left[node] = int(a), float(at), len(axis)
                for c in (axis, left, cell):
                    c.extend([-1, -1])
                cut.extend([0.0, 0.0])
                share = min(cells - 1, max(1, round(cells * low.mean())))
                grow(left[node], rows[low], share)
                grow(left[node] + 1, rows[~low], cells - share)
                return
        cell[node] = count
        count += 1

    grow(0, np.arange(len(sample)), cells)
    return np.array(axis), np.array(cut), np.array(left), np.array(cell)


def _cells(planes: tuple, x: np.ndarray) -> np.ndarray:
    axis, cut, left, cell = planes
    node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(rows):
        a = node[rows]
        rows, a = rows[axis[a] >= 0], a[axis[a] >= 0]
        node[rows] = left[a] + (x[rows, axis[a]] > cut[a])
    return cell[node]


def _box_distances(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(points, boxes): squared distances of the points to the boxes (0 inside)."""
    out = np.zeros((len(x), len(low)))
    for j in range(x.shape[1]):
        v = x[:, j, None]
        gap = np.maximum(np.maximum(low[:, j] - v, v - high[:, j]), 0)
        out += gap * gap
    return out


def _asked(x: np.ndarray, radius: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(point, box) of all boxes within each point's radius, by point and box."""
    reach, ones = radius**2 * (1 + 1e-9) + 1e-300, []
    for a in range(0, len(low), GROUP):
        z = min(a + GROUP, len(low))
        near = np.flatnonzero(_box_distances(x, low[a:z].min(axis=0)[None], high[a:z].max(axis=0)[None])[:, 0] <= reach)
        r, c = np.nonzero(_box_distances(x[near], low[a:z], high[a:z]) <= reach[near, None])
        ones.append((near[r], c + a))
    r, c = (np.concatenate(v) for v in zip(*ones))
    order = np.lexsort((c, r))
    return r[order], c[order]


def _sampled_planes(pts: DataFrame, n: int, block_rows: int) -> tuple:
    width = pts.select(F.size("vec").alias("d")).first()["d"]
    cells = math.ceil(n / (CELL * block_rows))
    most = max(2, min(SAMPLE_POINTS * cells, SAMPLE_NUMBERS // max(1, width)))
    share = min(1.0, most / n)
    drawn = pts.filter(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("vec").limit(2 * most)
    sample = np.array([r["vec"] for r in drawn.toLocalIterator() if r["vec"] is not None], np.float64).reshape(-1, width)
    return _planes(sample, max(1, min(cells, len(sample) // 4)))


def _put_into_cells(planes: tuple):
    def run(frames):
        for pdf in frames:
            at = _cells(planes, np.stack(pdf["vec"].to_numpy())) if len(pdf) else np.zeros(0, np.int64)
            yield pdf.assign(t=0.0, bucket=at.astype(np.int32))

    return run


def _ask(spark, boxes: pd.DataFrame):
    """Requests: a row for each run of cells, inside a wide block, whose boxes a point reaches; its own block is not asked."""
    tables = {}
    for label, one in boxes.groupby("label"):
        low, high = one.groupby("bucket")["low"].agg(lambda v: np.min(np.stack(v.to_list()), axis=0)), one.groupby("bucket")["high"].agg(lambda v: np.max(np.stack(v.to_list()), axis=0))
        tables[label] = low.index.to_numpy(), np.stack(low.to_list()), np.stack(high.to_list())
    shared = spark.sparkContext.broadcast(tables)

    def run(frames):
        for pdf in frames:
            for label, one in pdf.groupby("label"):
                cells, low, high = shared.value[label]
                for s in range(0, len(one), 4096):
                    part = one.iloc[s:s + 4096]
                    r, c = _asked(np.stack(part["vec"].to_numpy()), part["radius"].to_numpy(np.float64), low, high)
                    cell = cells[c]
                    other = (cell != part["bucket"].to_numpy()[r]) | (part["n_sub"].to_numpy()[r] > 1)
                    r, c, cell = r[other], c[other], cell[other]
                    if not len(r):
                        continue
                    start = np.ones(len(r), bool)
                    start[1:] = (r[1:] != r[:-1]) | (c[1:] != c[:-1] + 1) | (cell[1:] // WIDE != cell[:-1] // WIDE)
                    first = np.flatnonzero(start)
                    last = np.append(first[1:], len(r)) - 1
                    out = part.iloc[r[first]][["id", "label", "bucket", "sub", "radius", "vec"]]
                    yield out.assign(wide=(cell[first] // WIDE).astype(np.int32), b_lo=cell[first].astype(np.int32), b_hi=cell[last].astype(np.int32))

    return run


def knn_same_class(df: DataFrame, id_col: str, label_col: str, vec_col: str, k: int = 5,
                   block_rows: int = DEFAULT_BLOCK_ROWS, n_rows: int | None = None) -> DataFrame:
    """(id, label, rank, neighbor_id, distance) — the k nearest other points of the same label.

    ``n_rows`` (the number of points, when the caller already knows it) saves a counting pass."""
    pts = df.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(label_col).cast("long").alias("label"),
        F.col(vec_col).cast("array<double>").alias("vec"),
    )
    n = pts.count() if n_rows is None else int(n_rows)
    ensure_checkpoint_dir(pts.sparkSession)
    planes, splits = None, [-math.inf, math.inf]
    if n > 4 * block_rows:
        pts = pts.checkpoint(eager=True)  # read for the sample and for the cells
        planes = _sampled_planes(pts, n, block_rows)
        pts = pts.mapInPandas(_put_into_cells(planes), "id long, label long, vec array<double>, t double, bucket int")
    else:
        # with a handful of blocks a tree barely prunes anything
        pts = pts.withColumn("t", F.col("vec")[0] if n else F.lit(0.0))
        grid = 1024
        n_buckets = min(grid, max(1, math.ceil(n / block_rows)))
        cuts = []
        if n_buckets > 1:
            row = pts.agg(F.percentile_approx("t", [i / grid for i in range(1, grid)], 10 * grid).alias("c")).first()
            cuts = list(row["c"] or [])
        if cuts:
            step = len(cuts) / n_buckets
            picked = [cuts[min(len(cuts) - 1, int(round(i * step)) - 1)] for i in range(1, n_buckets)]
            splits = [-math.inf] + sorted({float(c) for c in picked}) + [math.inf]

    def bucket_of(df_, col, out):
        if len(splits) <= 2:
            return df_.withColumn(out, F.lit(0))
        b = Bucketizer(splits=splits, inputCol=col, outputCol=out)
        return b.transform(df_).withColumn(out, F.col(out).cast("int"))

    # the bucketed points feed the block sizes, pass 1, the request join and pass 2: materialise
    # them once in the shared checkpoint folder (a lost executor re-reads them, no recompute)
    pts = (bucket_of(pts, "t", "bucket") if planes is None else pts).checkpoint(eager=True)
    sizes = pts.groupBy("label", "bucket").agg(F.count(F.lit(1)).alias("cnt"))
    # one row per (label, bucket): bounded by n / block_rows + labels, so the broadcast size is bounded
    sizes = sizes.withColumn("n_sub", F.greatest(F.lit(1), F.ceil(F.col("cnt") / F.lit(block_rows))).cast("int"))
    # blocks = (label, bucket) pairs plus their hash sub-blocks: at most this many rows
    n_blocks_est = sizes.count() + math.ceil(n / block_rows)

    def small(d):
        return F.broadcast(d) if n_blocks_est <= MAX_BROADCAST_BLOCKS else d

    pts = pts.join(small(sizes.select("label", "bucket", "n_sub")), ["label", "bucket"])
    pts = pts.withColumn("sub", F.pmod(F.xxhash64("id"), F.col("n_sub")).cast("int"))

    # ---------------------------------------------------------------- pass 1: inside each block
    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["id"].to_numpy()
        vecs = np.stack(pdf["vec"].to_numpy()) if len(pdf) else np.zeros((0, 0))
        nb, ds = _top_k(ids, vecs, ids, vecs, k, exclude_self=True)
        radius = [d[-1] if len(d) == k else math.inf for d in ds]
        return pd.DataFrame({"id": ids, "label": pdf["label"].to_numpy(), "bucket": pdf["bucket"].to_numpy(),
                             "sub": pdf["sub"].to_numpy(), "n_sub": pdf["n_sub"].to_numpy(), "t": pdf["t"].to_numpy(), "radius": radius,
                             "nbrs": nb, "dists": ds} | ({} if planes is None else {
                                 "vec": list(vecs), "low": [vecs.min(axis=0)] + [None] * (len(ids) - 1), "high": [vecs.max(axis=0)] + [None] * (len(ids) - 1)}))

    schema1 = ("id long, label long, bucket int, sub int, n_sub int, t double, radius double, "
               "nbrs array<long>, dists array<double>")
    if planes is not None:
        schema1 += ", vec array<double>, low array<double>, high array<double>"  # the block's bounding box is with its first row
    # pass-1 output is read twice (requests and merge): checkpoint so the Python pass runs once
    p1 = pts.groupBy("label", "bucket", "sub").applyInPandas(local, schema1).checkpoint(eager=True)

    # ---------------------------------------------------------------- pass 2: blocks within reach
    def wide_of(c: str):
        return F.floor(F.col(c) / F.lit(WIDE)).cast("int")

    # a wide block that is still too large (a hot value) is split by a hash as blocks are
    wides = sizes.groupBy("label", wide_of("bucket").alias("wide")).agg(F.ceil(F.sum("cnt") / F.lit(WIDE * block_rows)).cast("int").alias("n_ws"))
    asker = ["label", "wide", F.col("id").alias("qid"), "radius", "b_lo", "b_hi", "bucket", "sub"]
    if planes is None:
        # the coordinate's bounds are rounded, so the reach is a little wider: no neighbour at a block's edge is lost
        reach = F.col("radius") + (F.abs("t") + F.col("radius")) * 1e-9
        req = p1.select("id", "label", "bucket", "sub", "n_sub", "radius",
                        (F.col("t") - reach).alias("t_lo"), (F.col("t") + reach).alias("t_hi"))
        req = bucket_of(bucket_of(req, "t_lo", "b_lo"), "t_hi", "b_hi")
        # who reaches no other block has its neighbours
        req = req.filter((F.col("b_lo") != F.col("bucket")) | (F.col("b_hi") != F.col("bucket")) | (F.col("n_sub") > 1))
        req = req.withColumn("wide", F.explode(F.sequence(wide_of("b_lo"), wide_of("b_hi"))))
        req = req.select(*asker).join(pts.select(F.col("id").alias("qid"), F.col("vec").alias("qvec")), "qid")
    else:
        # one row a block: bounded as the broadcasts of blocks are
        boxes = p1.filter("low is not null").select("label", "bucket", "low", "high").toPandas()
        req = p1.select("id", "label", "bucket", "sub", "n_sub", "radius", "vec").mapInPandas(
            _ask(pts.sparkSession, boxes), "id long, label long, bucket int, sub int, radius double, vec array<double>, wide int, b_lo int, b_hi int")
        req = req.select(*asker, F.col("vec").alias("qvec"))
    req = req.join(small(wides), ["label", "wide"]).withColumn("ws", F.explode(F.sequence(F.lit(0), F.col("n_ws") - 1))).drop("n_ws")

    def cross(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"id": pd.Series([], dtype="int64"), "nbrs": pd.Series([], dtype=object),
                                 "dists": pd.Series([], dtype=object)})
        right = right.sort_values("bucket", kind="stable")

        def block(pdf):
            return pdf["bucket"].to_numpy().astype(np.int64) * 2**32 + pdf["sub"].to_numpy()

        qids = left["qid"].to_numpy()
        nb, ds = _top_k(qids, np.stack(left["qvec"].to_numpy()), right["id"].to_numpy(), np.stack(right["vec"].to_numpy()), k,
                        exclude_self=False, limits=left["radius"].to_numpy(),
                        blocks=(left["b_lo"].to_numpy(), left["b_hi"].to_numpy(), block(left), right["bucket"].to_numpy(), block(right)))
        return pd.DataFrame({"id": qids, "nbrs": nb, "dists": ds})

    # A wide block asked by many points (a dense region, or high dimension where the 1-D bound prunes
    # little) is served in chunks of at most ``WIDE * block_rows`` askers, its points being
    # replicated once per chunk, so every cogroup group has a bounded number of rows on each side.
    keys = ["label", "wide", "ws"]
    n_req = req.groupBy(*keys).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(WIDE * block_rows)).cast("int").alias("n_rc"))
    # one row per asked block (at most n / block_rows rows), broadcast to both sides; each side gets
    # its own re-aliased copy so the two joins do not share attribute ids
    def n_req_copy():
        return small(n_req.select(*[F.col(c).alias(c) for c in n_req.columns]))

    req = req.join(n_req_copy(), keys).withColumn(
        "rc", F.pmod(F.xxhash64("qid"), F.col("n_rc")).cast("int")).drop("n_rc")
    right = pts.withColumn("wide", wide_of("bucket")).join(small(wides), ["label", "wide"]).withColumn(
        "ws", F.pmod(F.xxhash64("id", F.lit(1)), F.col("n_ws")).cast("int"))
    right = right.select(*keys, "id", "vec", "bucket", "sub").join(n_req_copy(), keys).withColumn(
        "rc", F.explode(F.sequence(F.lit(0), F.col("n_rc") - 1))).drop("n_rc")
    p2 = (req.groupBy(*keys, "rc")
          .cogroup(right.groupBy(*keys, "rc"))
          .applyInPandas(cross, "id long, nbrs array<long>, dists array<double>"))

    # ---------------------------------------------------------------- merge
    def explode_c(d):
        return d.select("id", F.explode(F.arrays_zip("nbrs", "dists")).alias("c")).select(
            "id", F.col("c.nbrs").alias("neighbor_id"), F.col("c.dists").alias("distance"))

    cand = explode_c(p1).unionByName(explode_c(p2))
    w = Window.partitionBy("id").orderBy("distance", "neighbor_id")
    top = cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    labels = pts.select("id", "label")
    return top.join(labels, "id").select("id", "label", F.col("rank").cast("int").alias("rank"),
                                         "neighbor_id", "distance")
