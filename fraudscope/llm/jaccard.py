"""Jaccard join of documents by their word shingles: pivots, Voronoi regions and triangle-inequality windows.

Jaccard distance is a metric.  A region's documents are measured against a few pivots; each belongs to the cell of its nearest pivot and
is replicated into the cells of other pivots that are at most twice the join's radius farther away, since only there can a partner be.
Cells are regions again, joined recursively with pivots of their own, until all their documents are linked or few are left;
those are compared where neither the pivots' distances nor the sizes rule a pair out.  Pivots are compared with their whole
region and need not go on.  Documents already linked to one another are not compared, so the links found are a forest with the
components of all links.

The first regions come from the same metric on parts of the shingle space.  Unrelated texts all lie at a distance near 1 from each other and
from any pivot, so windows over whole documents would hold everything.  The space of shingle hashes is halved, bit by bit, wherever a
document has more than ``part`` shingles.  If two documents are similar, then so are their restrictions to one of both halves, and
so on, down to a part in which they are equal: within the radius of a set that small there is no other set.  Equal parts are pivots
at distance zero with empty windows, and documents that share one, or are connected by shared ones, are a region.  Similar documents
share parts with a good share of their shingles (``shared``), so the smallest parts need not be looked at.

Regions of up to ``region`` shingles are joined in a task.  Larger ones are cut by Spark: pivots by smallest hash, distances in salted
pieces of bounded size, cells and windows as rows of the next round; a cell that will not shrink is compared in blocks of bounded size.

Shingles are known by 64-bit hashes.  Edge cases: null texts and texts without words have no shingles, component of their own id; equal
shingle sets are one point of the space; a null id never names a component that has another id; rows equal in id and text are kept;
an empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, lower_words, map_arrow, ship, stored, worker_cache
from .simhash import components

#: Slack for distances held as floating-point numbers.
EPS = 1e-9


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, n: int = 3) -> np.ndarray:
    """Sorted hashes of the distinct ``n``-word shingles; of a shorter text's whole sequence."""
    words = lower_words(text)
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64)
    known = worker_cache("words", dict)
    if len(known) > 1_000_000:
        known.clear()
    h = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        x = known.get(w)
        if x is None:
            x = known[w] = xxhash.xxh3_64_intdigest(w)
        h[i] = x
    out = h[: len(h) - n + 1]
    for k in range(1, n):
        out = _mix(out) + h[k: len(h) - n + 1 + k]
    return np.unique(_mix(out))


def shared(percent: int, part: int) -> Fraction:
    """Share of a document's shingles that lie in parts it has in common with a similar one.  With t the threshold, an equal part of s shingles
    adds (1-t)s to ``intersection - t * union``, which is at least 0 in all; any other part takes at least g for each of the document's shingles in it:
    t/s - (1-t) for a part of s <= part shingles that the partner has otherwise, t - part/s where only the document is cut on."""
    t = Fraction(percent, 100)
    g = min(t / part - (1 - t), t - Fraction(part, part + 1))
    if g <= 0:
        raise ValueError("the parts are too large for the threshold")
    return g / (1 - t + g)


def parts(points: np.ndarray, part: int, share: Fraction) -> np.ndarray:
    """Hashes of the parts of a sorted set, largest first, without the smallest ones that hold less than ``share`` of it together."""
    found, todo = [], [(0, len(points), 0)] if len(points) else []
    while todo:
        a, b, depth = todo.pop()
        if b - a <= part:
            found.append((a - b, xxhash.xxh3_64_intdigest(points[a:b].tobytes(), depth)))
            continue
        above = int(points[a]) >> (64 - depth) if depth else 0
        k = a + int(np.searchsorted(points[a:b], np.uint64(((above << 1) | 1) << (63 - depth))))
        todo += [x for x in ((a, k, depth + 1), (k, b, depth + 1)) if x[0] < x[1]]
    found.sort()
    left = 0
    while found and (left - found[-1][0]) < share * len(points):
        left -= found.pop()[0]
    return np.array([h for _, h in found], np.uint64)


class Region:
    """Exact join of the sets ``flat[starts[i]:starts[i+1]]`` by pivots.  ``links`` gets pairs of set numbers."""

    def __init__(self, flat: np.ndarray, starts: np.ndarray, percent: int, pivots: int = 8, few: int = 48):
        self.starts, self.sizes, self.percent, self.pivots, self.few = starts, np.diff(starts), percent, pivots, few
        self.radius = 1 - percent / 100
        distinct, self.points = np.unique(flat, return_inverse=True)
        self.mark = np.zeros(len(distinct), bool)
        self.label = np.arange(len(self.sizes))
        self.links: list[tuple[int, int]] = []

    def gather(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum(self.sizes[of])
        at = ends - self.sizes[of]
        return self.points[np.arange(ends[-1]) + np.repeat(self.starts[:-1][of] - at, self.sizes[of])], at

    def measure(self, x: int, of: np.ndarray, points: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Distances of x from the sets ``of``; those within the radius are linked."""
        own = self.points[self.starts[x]: self.starts[x + 1]]
        self.mark[own] = True
        both = np.add.reduceat(self.mark[points].astype(np.int64), at)
        self.mark[own] = False
        union = self.sizes[of] + self.sizes[x] - both
        near = of[100 * both >= self.percent * union]
        labels, first = np.unique(self.label[near], return_index=True)
        mine = self.label[x]
        self.links += [(x, int(y)) for g, y in zip(labels, near[first]) if g != mine]
        if len(labels) > 1 or (len(labels) and labels[0] != mine):
            self.label[np.isin(self.label, labels)] = mine
        return 1 - both / union

    def one(self, of: np.ndarray) -> bool:
        return len(of) < 2 or bool((self.label[of] == self.label[of[0]]).all())

    def join(self) -> list[tuple[int, int]]:
        todo = [(np.arange(len(self.sizes)), np.ones(len(self.sizes), bool))]
        while todo:
            of, own = todo.pop()
            if self.one(of) or not own.any():
                continue
            points, at = self.gather(of)
            far, picked, rows = np.where(own, np.inf, -1.0), [], []
            while len(picked) < self.pivots and far.max() > 0 and not self.one(of):
                p = int(far.argmax())  # the farthest from the pivots so far
                rows.append(self.measure(of[p], of, points, at))
                picked.append(p)
                far = np.minimum(far, np.where(own, rows[-1], -1.0))
            if self.one(of):
                continue
            d = np.array(rows)
            cell, nearest = d.argmin(axis=0), d.min(axis=0)
            rest = np.ones(len(of), bool)
            rest[picked] = False
            cells = []
            for j in range(len(picked)):
                window = d[j] <= nearest + 2 * self.radius + EPS
                # one of two cells compares a pair of their own documents; a guest from above is a guest in every cell it may have partners in
                in_cell = rest & ((cell == j) | (window & (~own | (cell > j))))
                cells.append((of[in_cell], (own & (cell == j))[in_cell]))
            if len(of) <= self.few or max(len(c) for c, _ in cells) > 0.7 * len(of):
                self.compare(of, own, rest, d)
            else:
                todo += cells
        return self.links

    def compare(self, of: np.ndarray, own: np.ndarray, rest: np.ndarray, d: np.ndarray) -> None:
        """Pairs that are not yet connected and that the pivots' distances and the sizes allow."""
        size = self.sizes[of]
        for x in np.flatnonzero(own & rest):
            able = rest & (self.label[of] != self.label[of[x]]) & (np.abs(d - d[:, x: x + 1]).max(axis=0) <= self.radius + EPS)
            able &= (100 * np.minimum(size, size[x]) >= self.percent * np.maximum(size, size[x])) & (~own | (np.arange(len(of)) > x))
            if able.any():
                self.measure(of[x], of[able], *self.gather(of[able]))


def _joined(percent: int):
    def run(t: pa.Table) -> pa.Table:
        rid, sets = t.column("rid").to_numpy(), t.column("points").combine_chunks()
        starts = sets.offsets.to_numpy().astype(np.int64)
        pairs = Region(sets.values.to_numpy()[starts[0]:].view(np.uint64), starts - starts[0], percent).join() if len(rid) > 1 else []
        return pa.table({"a": pa.array(rid[[p for p, _ in pairs]], pa.int64()), "b": pa.array(rid[[q for _, q in pairs]], pa.int64())})

    return run


MEMBER = "cell string, rid long, own boolean, near boolean, above long, points array<long>"


def _cut(percent: int):
    """A piece of a large region against the region's pivots: links as rows without a cell, cells and windows as members of the next round."""
    radius = 1 - percent / 100

    def run(key, members: pa.Table, pivots: pa.Table) -> pa.Table:
        out = {c: [] for c in ("cell", "rid", "own", "near", "above", "points", "link")}
        chosen = [(p["rid"], np.array(p["points"], np.int64)) for p in pivots.column("pivots")[0].as_py()]
        above, name = pivots.column("elements")[0].as_py(), key[0].as_py()
        names = {p for p, _ in chosen}
        for rid, own, points in zip(members.column("rid").to_pylist(), members.column("own").to_pylist(), members.column("points")):
            x = points.values.to_numpy()
            both = [len(np.intersect1d(x, p, assume_unique=True)) for _, p in chosen]
            union = [len(x) + len(p) - b for (_, p), b in zip(chosen, both)]
            linked = [100 * b >= percent * u for b, u in zip(both, union)]
            d = [1 - b / u for b, u in zip(both, union)]
            rows = [(None, None, None, p) for (p, _), near in zip(chosen, linked) if near and p != rid]
            if rid not in names:
                home = int(np.argmin(d))
                rows += [(f"{name}/{j}", own and j == home, linked[j], None) for j in range(len(d))
                         if j == home or (d[j] <= d[home] + 2 * radius + EPS and (not own or home > j))]
            for cell, mine, near, link in rows:
                for c, v in zip(out, (cell, rid, mine, near, above, points.as_py() if cell else None, link)):
                    out[c].append(v)
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.int64())
        return pa.table({c: pa.array(v, k) for (c, v), k in zip(out.items(), kinds)})

    return run


def region_links(members: DataFrame, percent: int, region: int, pivots: int = 16) -> DataFrame:
    """``a, b``: a forest of links with the components of all links inside the cells of ``members`` (``cell, rid, own, near, above, points``)."""
    ship(members.sparkSession)
    found, turn = [], 0
    while True:
        turn += 1
        facts = members.groupBy("cell").agg(
            F.sum(F.size("points")).alias("elements"), F.count(F.lit(1)).alias("n"), F.bool_and("near").alias("all_near"), F.bool_or("own").alias("any_own"), F.max("above").alias("before"))
        facts = stored(facts.filter("n > 1 and not all_near and any_own").select(F.col("cell").alias("_cell"), "elements", "before"), "cells")
        sized = members.join(facts, F.col("cell") == F.col("_cell")).drop("_cell")
        ready = sized.filter(F.col("elements") <= region).select("cell", "rid", "points")
        # a cell that has not lost a fifth of its parent is compared in blocks: block i with block j, for all i <= j
        stuck = sized.filter((F.col("elements") > region) & (F.col("elements") > 0.8 * F.col("before")))
        blocks = F.ceil(F.lit(2.0) * F.col("elements") / region).cast("int")
        stuck = stuck.withColumn("blocks", blocks).withColumn("block", F.expr("pmod(xxhash64(rid), blocks)").cast("int"))
        against = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
        stuck = stuck.select("cell", "rid", "points", "block", against)
        stuck = stuck.select(F.concat_ws("#", "cell", F.least("block", "other"), F.greatest("block", "other")).alias("cell"), "rid", "points")
        found.append(stored(ready.unionByName(stuck).groupBy("cell").applyInArrow(_joined(percent), "a long, b long"), "links"))
        large = facts.filter((F.col("elements") > region) & (F.col("elements") <= 0.8 * F.col("before")))
        if large.isEmpty():
            break
        mine = sized.filter((F.col("elements") > region) & (F.col("elements") <= 0.8 * F.col("before")))
        order = Window.partitionBy("cell").orderBy(F.xxhash64("rid", F.lit(turn)), "rid")
        chosen = mine.filter("own").select("cell", "rid").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= pivots)
        chosen = stored(chosen.select(F.col("cell").alias("_cell"), F.col("rid").alias("_rid")), "pivots")
        held = members.filter("own").join(chosen, (F.col("cell") == F.col("_cell")) & (F.col("rid") == F.col("_rid")))
        held = held.groupBy("cell").agg(F.collect_list(F.struct("rid", "points")).alias("pivots"))
        held = held.join(large, F.col("cell") == F.col("_cell")).select("cell", "pivots", "elements")
        pieces = F.ceil(F.lit(2.0) * F.col("elements") / region).cast("int")
        salted = mine.withColumn("_pieces", pieces).withColumn("salt", F.expr("pmod(xxhash64(rid), _pieces)").cast("int")).select("cell", "salt", "rid", "own", "points")
        held = stored(held, "pivots")  # a table for each region, of as many sets as it has pivots
        spread = held.withColumn("salt", F.explode(F.sequence(F.lit(0), pieces - 1))).select("cell", "salt", "pivots", "elements")
        cut = salted.groupBy("cell", "salt").cogroup(spread.groupBy("cell", "salt")).applyInArrow(_cut(percent), MEMBER + ", link long")
        cut = stored(cut, "regions")
        found.append(cut.filter("link is not null").select(F.col("rid").alias("a"), F.col("link").alias("b")))
        members = cut.filter("link is null").drop("link")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def similar(docs: DataFrame, percent: int = 90, shingle: int = 3, part: int = 7, region: int = 1 << 20) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document; two are linked when ``100 * intersection >= percent * union``."""
    ship(docs.sparkSession)
    share = shared(percent, part)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))

    def name(points: np.ndarray) -> bytes:
        return xxhash.xxh3_128_digest(points.tobytes())

    def look(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t, shingle) for t in b.column("text").to_pylist()]
        return batch(
            doc_id=b.column("doc_id"), text_hash=b.column("text_hash"), point=([name(s) if len(s) else None for s in sets], pa.binary()),
            n=([len(s) for s in sets], pa.int64()), parts=([parts(s, part, share).view(np.int64) for s in sets], pa.list_(pa.int64())))

    seen = stored(map_arrow(d, look, "doc_id long, text_hash long, point binary, n long, parts array<long>", rows=128), "points")
    # one row for each distinct set; its smallest id names it
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("least")
    distinct = seen.filter("point is not null").groupBy("point").agg(least, F.first("parts").alias("parts"))
    distinct = distinct.select(F.monotonically_increasing_id().alias("rid"), "point", "least.doc_id", "least.text_hash", "parts")
    distinct = stored(distinct, "distinct")

    each = distinct.select("rid", F.explode("parts").alias("h"))
    several = each.groupBy("h").agg(F.min("rid").alias("low"), F.max("rid").alias("high"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    several = stored(several, "equal-parts")
    others = several.filter("k > 2").select(F.col("h").alias("_h"), "low")
    edges = each.join(others, F.col("h") == F.col("_h")).filter("rid <> low").select(F.col("rid").alias("a"), F.col("low").alias("b"))
    edges = edges.unionByName(several.filter("k = 2").select(F.col("high").alias("a"), F.col("low").alias("b"))).distinct()
    regions = components(edges)  # all but the smallest of each
    regions = stored(regions.unionByName(regions.select(F.col("root").alias("node"), "root").distinct()), "region-of")

    wanted = distinct.drop("parts").join(regions, F.col("rid") == F.col("node")).select(
        F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_text"), "point", "rid", F.col("root").cast("string").alias("cell"))
    texts = d.join(wanted, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_text"))).select("cell", "rid", "point", "text")

    def again(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t, shingle) for t in b.column("text").to_pylist()]
        ok = pa.array([name(s) == p for s, p in zip(sets, b.column("point").to_pylist())], pa.bool_())
        points = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
        return batch(cell=b.column("cell"), rid=b.column("rid"), points=points).filter(ok)

    members = stored(map_arrow(texts, again, "cell string, rid long, points array<long>", rows=128), "members")
    members = members.select("cell", "rid", F.lit(True).alias("own"), F.lit(False).alias("near"), F.lit(2**62).alias("above"), "points")
    roots = components(region_links(members, percent, region))
    named = distinct.select("rid", "point", "doc_id").join(roots, F.col("rid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "rid"))
    named = stored(named.select("point", "doc_id", "root"), "named")
    low = named.groupBy("root").agg(F.min("doc_id").alias("component"))
    named = named.join(low, "root").select(F.col("point").alias("_point"), "component")
    out = seen.join(named, F.col("point") == F.col("_point"), "left")
    component = F.when(F.col("point").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


#: The same rows in DuckDB: documents that share a shingle are compared, then connected.
SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM shingles x JOIN shingles y ON x.s = y.s JOIN sizes p ON p.doc_id = x.doc_id JOIN sizes q ON q.doc_id = y.doc_id
  WHERE x.doc_id <> y.doc_id AND 100 * least(p.n, q.n) >= 90 * greatest(p.n, q.n)
  GROUP BY x.doc_id, y.doc_id HAVING 100 * count(*) >= 90 * (max(p.n) + max(q.n) - count(*))),
reached AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, p.b FROM reached r JOIN pairs p ON p.a = r.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(b) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN reached ON a = d.doc_id GROUP BY ALL
"""
