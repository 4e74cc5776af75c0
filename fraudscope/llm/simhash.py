"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints are the bit-majority of the shingles' XXH64 hashes.  The distinct fingerprints are ordered by Gray rank (their place in
the reflected Gray sequence), so that neighbours share long bit patterns, and cut into groups of consecutive ranks.  Each node of
the hierarchy stores the bits that all fingerprints below it share and its parent does not; a search adds up the differing
shared bits on its way down and drops a node, with everything below it, as soon as the sum exceeds the limit.  The
same descent first routes each fingerprint to the groups whose shared bits allow a partner (the roots, at most ``max_groups``, are
all the driver sees) and then runs inside each group in a task.  Links are reduced to a spanning forest per task and united by
repeated minimum contraction over stored tables.

Edge cases: null and empty texts have fingerprint zero and link like any other; texts shorter than a shingle are one shingle;
repeated rows share a fingerprint; a null id never is a component's name unless every id in it is null; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, fresh, lower_words, map_arrow, ship, stored

ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    words = lower_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        parts = [joined]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        parts = [joined[s:e] for s, e in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist())]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(p, seed) for p in parts), np.uint64, len(parts))
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(parts), bitorder="little").view(np.uint64)[0])


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each 64-bit pattern in the reflected Gray sequence."""
    r = x.astype(np.uint64)
    for s in (1, 2, 4, 8, 16, 32):
        r = r ^ (r >> np.uint64(s))
    return r


class GrayIndex:
    """Hierarchy over patterns given in Gray order.  A leaf is a pattern with the mask of its certain bits."""

    def __init__(self, pattern: np.ndarray, mask: np.ndarray | None = None, fan: int = 8):
        mask = np.full(len(pattern), ONES) if mask is None else mask
        self.fan = fan
        self.levels = [(pattern, mask)]
        while len(self.levels[-1][0]) > 1:
            p, m = self.levels[-1]
            at = np.arange(0, len(p), fan)
            both = np.bitwise_and.reduceat(p, at)
            any_ = np.bitwise_or.reduceat(p, at)
            self.levels.append((both, np.bitwise_and.reduceat(m, at) & ~(both ^ any_)))
        # below the top a node keeps only the bits that its parent has not factored out already
        self.own = [m.copy() for _, m in self.levels]
        for k in range(len(self.levels) - 1):
            self.own[k] &= ~np.repeat(self.levels[k + 1][1], fan)[: len(self.own[k])]

    def search(self, queries: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """All (query number, leaf number) that differ in at most ``limit`` certain bits."""
        top = len(self.levels) - 1
        q, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        if not len(self.levels[0][0]):
            return q[:0], node[:0]
        sums = np.zeros(len(q), np.int64)
        for k in range(top, -1, -1):
            if k < top:
                q, sums = np.repeat(q, self.fan), np.repeat(sums, self.fan)
                node = (node[:, None] * self.fan + np.arange(self.fan)).ravel()
                there = node < len(self.levels[k][0])
                q, node, sums = q[there], node[there], sums[there]
            sums = sums + np.bitwise_count((queries[q] ^ self.levels[k][0][node]) & self.own[k][node])
            near = sums <= limit
            q, node, sums = q[near], node[near], sums[near]
        return q, node


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest reachable number of each of 0..n-1 under the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, text_hash, fp``: the fingerprint as a signed 64-bit number."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], np.uint64)
        return batch(doc_id=b.column("doc_id"), text_hash=b.column("text_hash"), fp=pa.array(fps.view(np.int64)))

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    return map_arrow(d, run, "doc_id long, text_hash long, fp long")


def links(distinct: DataFrame, limit: int, group_rows: int, max_groups: int, min_groups: int = 16) -> DataFrame:
    """``a, b``: a spanning forest, per group, of all pairs of distinct fingerprints within ``limit`` bits."""
    spark = distinct.sparkSession
    # Gray rank with the top bit turned, so that signed order is unsigned order
    rank = F.col("fp")
    for s in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, s))
    ranked = stored(distinct.select("fp", rank.bitwiseXOR(F.lit(-(2**63))).alias("rank")), "gray")
    n = ranked.count()
    groups = 0 if n < 2 else max(min_groups, min(max_groups, -(-n // group_rows)))
    cuts = [] if groups < 2 else ranked.select(F.percentile_approx("rank", [k / groups for k in range(1, groups)], 20 * groups)).first()[0]
    cuts = np.unique(np.array(cuts, np.int64))

    def place(b: pa.RecordBatch) -> pa.RecordBatch:
        gid = np.searchsorted(cuts, b.column("rank").to_numpy(), side="right")
        return batch(fp=b.column("fp"), gid=pa.array(gid.astype(np.int32)))

    placed = map_arrow(ranked, place, "fp long, gid int", rows=65536)
    roots = {r["gid"]: r for r in placed.groupBy("gid").agg(F.bit_and("fp").alias("all"), F.bit_or("fp").alias("any")).collect()}
    gids = np.array(sorted(roots), np.int32)
    both = np.array([roots[g]["all"] for g in gids], np.int64).view(np.uint64)
    some = np.array([roots[g]["any"] for g in gids], np.int64).view(np.uint64)

    def route(b: pa.RecordBatch) -> pa.RecordBatch:
        fps, own = b.column("fp").to_numpy().view(np.uint64), b.column("gid").to_numpy()
        q, at = GrayIndex(both, ~(both ^ some)).search(fps, limit)
        to = gids[at]
        keep = to >= own[q]  # a pair is found in the later of its two groups
        q, to = q[keep], to[keep]
        return batch(gid=pa.array(to), fp=pa.array(fps[q].view(np.int64)), member=pa.array(to == own[q]))

    routed = map_arrow(placed, route, "gid int, fp long, member boolean", rows=4096)

    def join(t: pa.Table) -> pa.Table:
        fps, member = t.column("fp").to_numpy().view(np.uint64), t.column("member").to_numpy()
        own = fps[member]
        own = own[np.argsort(gray_rank(own), kind="stable")]
        index = GrayIndex(own)
        every = np.concatenate([own, fps[~member]])
        label = np.arange(len(every))
        a, b = [], []
        for i in range(0, len(every), 4096):
            q, leaf = index.search(every[i: i + 4096], limit)
            q = q + i
            a.append(q[q != leaf])
            b.append(leaf[q != leaf])
            if sum(map(len, a)) > 1_000_000:  # links fold into the labels as they come
                label = forest(np.concatenate([np.arange(len(every)), *a]), np.concatenate([label, *b]), len(every))
                a, b = [], []
        label = forest(np.concatenate([np.arange(len(every)), *a]), np.concatenate([label, *b]), len(every))
        linked = label != np.arange(len(every))
        return pa.table({"a": pa.array(every[linked].view(np.int64)), "b": pa.array(every[label[linked]].view(np.int64))})

    return routed.groupBy("gid").applyInArrow(join, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node reachable, for every node on a link.  Minimum contraction: in each round every node's
    links move to its smallest neighbour (once from larger to smaller, once among the smaller ones); rounds grow with the
    logarithm of the longest chain, and each is a stored table."""
    e = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = stored(large, "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        e = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now


def near_duplicates(docs: DataFrame, shingle: int = 3, limit: int = 2, group_rows: int = 32768, max_groups: int = 4096, carry: bool = False) -> DataFrame:
    """``doc_id, fp, component_id`` of every document; fingerprints at ``limit`` or fewer differing bits are linked.  ``carry`` adds the
    text's hash and the component's smallest fingerprint (``text_hash, component``)."""
    ship(docs.sparkSession)
    marked = stored(fingerprints(docs, shingle), "fps")
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    found = links(distinct.select("fp"), limit, group_rows, max_groups)
    rooted = components(found)
    named = distinct.join(rooted.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = stored(named, "named")
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(least, "root").select(F.col("fp").alias("_fp"), F.col("root").alias("component"), "component_id")
    out = marked.join(named, F.col("fp") == F.col("_fp"))
    return out.select("doc_id", "fp", "component_id", *(["text_hash", "component"] if carry else []))


def digests(out: DataFrame) -> DataFrame:
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, shingle: int = 3, limit: int = 2) -> DataFrame:
    """One document of each component, all columns as they were: the smallest id, among equal ids the text with the smallest hash,
    among equal rows any one."""
    c1, c2 = fresh(docs, "id"), fresh(docs, "hash")
    keyed = docs.withColumns({c1: F.col("doc_id").cast("long"), c2: F.xxhash64(F.coalesce("text", F.lit("")))})
    marked = near_duplicates(docs.select("doc_id", "text"), shingle, limit, carry=True)
    one = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("one")
    keep = stored(marked.groupBy("component").agg(one).select(F.col("one.doc_id").alias("_k1"), F.col("one.text_hash").alias("_k2")), "kept")
    out = keyed.join(keep, keyed[c1].eqNullSafe(keep["_k1"]) & (keyed[c2] == keep["_k2"]), "left_semi")
    return out.dropDuplicates([c1, c2]).select(*docs.columns)
