"""Benchmark decontamination: hash set of normalised test n-grams, scanned over every window of the training text.

The benchmark's windows are distinct rows of word numbers with the items they come from.  They travel to the tasks as a
broadcast, in blocks of at most ``block_windows`` windows (a proven size); a benchmark larger than one block is scanned in
several passes whose hits are united per document.  A task turns a text into word numbers (0: not in the block's
vocabulary), rolls a hash over them, looks hashes up in the sorted set, and verifies each hit word by word.

Edge cases: null texts have no words, are never hit and never clean away; items without words have no windows; repeated rows of
documents give repeated rows; repeated items count once per id; null item ids are ignored in the id list; an empty benchmark
leaves every document clean; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, map_arrow, ship, slices, stored

#: Bytes that belong to words after lower-casing: 0-9, a-z and everything from 0x80 on; A-Z map to a-z, all others to a blank.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(NORMAL).split()


def windows_of(text: str | None, n: int) -> list[bytes]:
    """Distinct windows of an item, blank-joined; a shorter item is one window."""
    w = words_of(text)
    if not w:
        return []
    return list(dict.fromkeys(b" ".join(w[i: i + n]) for i in range(max(1, len(w) - n + 1))))


def _roll(ids: np.ndarray, n: int) -> np.ndarray:
    h = np.zeros(len(ids) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            h = h * ODD + ids[j: len(ids) - n + 1 + j].astype(np.uint64)
        h ^= h >> np.uint64(29)
    return h


class WindowSet:
    """The windows of one block: by length, sorted hashes with the words to verify and the item ids."""

    def __init__(self, rows: list[tuple[bytes, list[int]]]):
        self.vocab: dict[bytes, int] = {}
        by_len: dict[int, list] = {}
        for text, items in rows:
            w = [self.vocab.setdefault(x, len(self.vocab) + 1) for x in text.split()]
            by_len.setdefault(len(w), []).append((w, items))
        self.tables = {}
        for n, entries in by_len.items():
            grid = np.array([e[0] for e in entries], np.int64).reshape(-1, n)
            hashes = np.concatenate([_roll(r, n) for r in grid])
            order = np.argsort(hashes, kind="stable")
            self.tables[n] = (hashes[order], grid[order], [entries[k][1] for k in order])

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Mask of hit words and the items whose windows occur."""
        hit, items = np.zeros(len(words), bool), set()
        ids = np.fromiter((self.vocab.get(w, 0) for w in words), np.int64, len(words))
        if not ids.any():
            return hit, items
        for n, (hashes, grid, owners) in self.tables.items():
            if len(ids) < n:
                continue
            h = _roll(ids, n)
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            for p in np.flatnonzero(hi > lo):
                for k in range(lo[p], hi[p]):  # more than one only where hashes collide
                    if np.array_equal(ids[p: p + n], grid[k]):
                        hit[p: p + n] = True
                        items.update(owners[k])
        return hit, items


def benchmark_windows(bench: DataFrame, n: int) -> DataFrame:
    """``window, items``: distinct windows with the sorted ids of the items that hold them."""
    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(w, i) for i, t in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist()) for w in windows_of(t, n)]
        return batch(window=([r[0] for r in rows], pa.binary()), item_id=([r[1] for r in rows], pa.int64()))

    cuts = map_arrow(bench.select(F.col("item_id").cast("long").alias("item_id"), "text"), cut, "window binary, item_id long")
    return cuts.groupBy("window").agg(F.sort_array(F.collect_set("item_id")).alias("items"))


def text_key(text) -> Column:
    """16 bytes that tell the texts of one id apart; a null text is an empty one."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def scan_benchmark(docs: DataFrame, bench: DataFrame, n: int = 10, block_windows: int = 200_000, with_row: bool = False) -> DataFrame:
    """``doc_id, n_words, hits, items``: word positions ``[start, end)`` inside occurrences, and the items found, per document;
    ``with_row`` adds the text's key as ``row``."""
    spark = docs.sparkSession
    ship(spark)
    table = stored(benchmark_windows(bench, n), "bench")
    blocks = max(1, -(-table.count() // block_windows))
    # a block holds block_windows rows on average; hashing the window text spreads them evenly
    table = table.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(blocks)))
    key = text_key(F.col("text")) if with_row or blocks > 1 else F.lit(None).cast("binary")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", key.alias("row"))
    schema = "doc_id long, n_words long, hits array<struct<start:int,end:int>>, items array<long>, row binary"
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def scanner(block: int):
        rows = [(bytes(r["window"]), list(r["items"])) for r in table.filter(F.col("block") == block).collect()]
        sent = spark.sparkContext.broadcast(rows)
        made: list[WindowSet] = []

        def run(batches):
            windows = made[0] if made else WindowSet(sent.value)
            if not made:
                made.append(windows)
            for whole in batches:
                for b in slices(whole, 512):
                    size, hits, found = [], [], []
                    for text in b.column("text").to_pylist():
                        words = words_of(text)
                        mask, items = windows.scan(words)
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                        size.append(len(words))
                        hits.append([{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2])])
                        found.append(sorted(items))
                    yield batch(doc_id=b.column("doc_id"), n_words=(size, pa.int64()), hits=(hits, spans), items=(found, pa.list_(pa.int64())), row=b.column("row").cast(pa.binary()))

        return d.mapInArrow(run, schema).withColumn("block", F.lit(block))

    out = scanner(0)
    if blocks == 1:
        return out.drop("block") if with_row else out.drop("row", "block")
    for k in range(1, blocks):
        out = out.unionByName(scanner(k))

    def unite(t: pa.Table) -> pa.Table:
        mask = np.zeros(t.column("n_words")[0].as_py(), bool)
        items: set[int] = set()
        for spans_, found in zip(t.column("hits").to_pylist(), t.column("items").to_pylist()):
            items.update(found)
            for s in spans_:
                mask[s["start"]: s["end"]] = True
        copies = t.column("block").to_pylist().count(0)  # repeated rows share a group
        edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
        hits = [{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2])]
        return pa.Table.from_batches([batch(
            doc_id=([t.column("doc_id")[0].as_py()] * copies, pa.int64()), n_words=([len(mask)] * copies, pa.int64()),
            hits=([hits] * copies, spans), items=([sorted(items)] * copies, pa.list_(pa.int64())),
            row=([t.column("row")[0].as_py()] * copies, pa.binary()))])

    # a document row meets its own blocks only: groups are as small as the number of blocks times its exact repetitions
    united = out.groupBy("doc_id", "row").applyInArrow(unite, schema)
    return united if with_row else united.drop("row")


def digests(scanned: DataFrame) -> DataFrame:
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"]).cast("long"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return scanned.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, bench: DataFrame, n: int = 10) -> DataFrame:
    """The documents without those that hold a benchmark window; all columns as they were.

    Documents are matched to their scan by id and text, a null id by null: rows that share an id, or have none, go by their own text.
    """
    hit = scan_benchmark(docs, bench, n, with_row=True).filter(F.size("hits") > 0)
    bad = stored(hit.select(F.col("doc_id").alias("_bad"), F.col("row").alias("_row")).distinct(), "leaks")
    same = docs["doc_id"].cast("long").eqNullSafe(bad["_bad"]) & (text_key(docs["text"]) == bad["_row"])
    return docs.join(bad, same, "left_anti")
