"""Substring dedup on sliding sentence spans.

Every run of at least ``span`` consecutive sentences is hashed; hashes that occur more than once are found by a partial aggregation, those runs
are joined with the first occurrence of their hash (lowest document id, then position), and every sentence inside a run that is not the
first occurrence is removed.

A sentence ends after ``.``, ``!``, ``?`` or ``…`` followed by white space, or at a line break; white space around it does not
count, and its words are compared lower-cased (A-Z) with single blanks.  Long sentences are cut into clauses at places that depend on
the words alone, so that a passage inside them is found wherever it starts.  A run that has fewer than ``min_words`` words (``Yes. No.
Why?``) goes on over the following sentences until it has them or the text ends; a text of fewer than ``span`` sentences is one run.

Edge cases: null and empty texts have no sentences and lose nothing; rows that share an id are told apart by their text's hash;
rows equal in id and text are one document given twice, with one result for both; null ids come first; other columns are
ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, batch, map_arrow, ship, stored

SENTENCE = re.compile(r"[^\n]+?(?:[.!?…]+(?=\s)|(?=\n)|$)|\n", re.ASCII)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A sentence of more words is cut into clauses after words whose hash is a multiple of CUT (the same words everywhere), or after LONG words.
LONG, CUT = 16, 8


def sentences(text: str | None) -> list[tuple[int, int, bytes]]:
    """(start, end, normalised words) of each sentence or clause with a word; start and end are characters of the text."""
    out = []
    for m in SENTENCE.finditer(text or ""):
        words = m.group().encode("utf-8", "replace").translate(LOWER).split()
        if len(words) > LONG:
            at, since = m.start(), 0
            for k, w in enumerate(WORD.finditer(m.group())):
                if k + 1 < len(words) and (xxhash.xxh3_64_intdigest(words[k]) % CUT == 0 or k + 1 - since == LONG):
                    out.append((at, m.start() + w.end(), b" ".join(words[since: k + 1])))
                    at, since = m.start() + w.end(), k + 1
            out.append((at, m.end(), b" ".join(words[since:])))
        elif words:
            out.append((m.start(), m.end(), b" ".join(words)))
    return out


def runs(parts: list[tuple[int, int, bytes]], span: int, min_words: int) -> list[tuple[int, int, bytes]]:
    """(first sentence, sentences, hash) of each run: from every sentence on, at least ``span`` sentences, and ``min_words`` words
    unless the text ends before.  A text with fewer sentences than ``span`` is one run."""
    ends = np.concatenate([[0], np.cumsum([p[2].count(b" ") + 1 for p in parts])]).astype(np.int64)
    first = np.arange(max(0, len(parts) - span) + 1 if parts else 0)
    last = np.maximum(np.searchsorted(ends, ends[first] + min_words), first + span).clip(max=len(parts))
    words = [p[2] for p in parts]
    return [(i, j - i, xxhash.xxh3_128_digest(b"\n".join(words[i:j]))) for i, j in zip(first.tolist(), last.tolist())]


def _repeated_filter(seen: DataFrame, most_bits: int) -> tuple[np.ndarray, int]:
    """A bitmap with the places of the short hashes that occur more than once, and its mask.  It has sixteen bits for each of them, up to
    ``most_bits``; beyond that more hashes that occur once pass it, and the exact step behind it has more to do."""
    def short(b: pa.RecordBatch) -> pa.RecordBatch:
        return batch(h=pa.array(np.concatenate([np.frombuffer(x, np.int64)[::2] for x in b.column("hashes").to_pylist()] or [np.empty(0, np.int64)])))

    again = stored(map_arrow(seen, short, "h long", rows=256).groupBy("h").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("h"), "repeated")
    bits = 1 << 16
    while bits < min(16 * again.count(), most_bits):
        bits *= 2
    place = F.col("h").bitwiseAND(F.lit(bits - 1))
    words = again.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, int((h & {bits - 1}L) & 63))")).alias("set")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("set").to_numpy()
    return out.view(np.uint64), bits - 1


def span_duplicates(docs: DataFrame, span: int = 3, min_words: int = 12, most_bits: int = 1 << 28) -> DataFrame:
    """``doc_id, n_sentences, removed (sentence numbers), n_spans, kept``: ``kept`` is the text without the removed sentences.

    Texts are parsed once; the runs' 128-bit hashes are stored, one row a document.  Their halves alone are shuffled to find which occur more
    than once; only runs that pass the bitmap of those are exploded and settled by the whole hash."""
    spark = docs.sparkSession
    ship(spark)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("row", F.xxhash64("text"))

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        parts = [sentences(t) for t in b.column("text").to_pylist()]
        hashes = [b"".join(h for _, _, h in runs(p, span, min_words)) for p in parts]
        return batch(doc_id=b.column("doc_id"), row=b.column("row"), n=([len(p) for p in parts], pa.int64()), hashes=(hashes, pa.binary()))

    seen = stored(map_arrow(d, cut, "doc_id long, row long, n long, hashes binary", rows=256), "runs")
    words, mask = _repeated_filter(seen, most_bits)
    held = spark.sparkContext.broadcast(words)  # most_bits / 8 bytes at most

    def survivors(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, rows, at, h = [], [], [], []
        for doc, row, raw in zip(*(b.column(c).to_pylist() for c in ("doc_id", "row", "hashes"))):
            place = np.frombuffer(raw, np.uint64)[::2] & np.uint64(mask)
            hit = np.flatnonzero((held.value[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1))
            ids += [doc] * len(hit)
            rows += [row] * len(hit)
            at += hit.tolist()
            h += [raw[16 * i: 16 * i + 16] for i in hit.tolist()]
        return batch(doc_id=(ids, pa.int64()), row=(rows, pa.int64()), at=(at, pa.int32()), h=(h, pa.binary()))

    found = stored(map_arrow(seen, survivors, "doc_id long, row long, at int, h binary", rows=256), "candidates")
    first = F.min(F.struct("doc_id", "row", "at")).alias("first")
    repeated = stored(found.groupBy("h").agg(first, F.count(F.lit(1)).alias("k")).filter("k > 1").select(F.col("h").alias("rh"), "first"), "firsts")
    later = stored(
        found.join(repeated, F.col("h") == F.col("rh")).filter(~(F.struct("doc_id", "row", "at").eqNullSafe(F.col("first"))))
        .groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("at")).alias("ats")), "spans")  # one list per document, as long as its text
    later = later.withColumnsRenamed({"doc_id": "_d", "row": "_r"})
    counts = seen.select(F.col("doc_id").alias("_d"), F.col("row").alias("_r"), "n").distinct()  # equal rows have equal counts
    facts = counts.join(later, counts["_d"].eqNullSafe(later["_d"]) & (counts["_r"] == later["_r"]), "left").select(counts["_d"], counts["_r"], "n", "ats")
    marked = d.join(facts, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("row") == F.col("_r"))).select("doc_id", "text", "n", "ats")

    def drop(b: pa.RecordBatch) -> pa.RecordBatch:
        gone, count, kept = [], [], []
        for text, ats in zip(b.column("text").to_pylist(), b.column("ats").to_pylist()):
            if not ats:
                gone.append([]), count.append(0), kept.append(text)
                continue
            parts = sentences(text)
            lengths = [n for _, n, _ in runs(parts, span, min_words)]
            mask = np.zeros(len(parts) + 1, np.int8)
            for x in ats:
                mask[x: x + lengths[x]] = 1
            mask = mask[: len(parts)]
            out, p = [], 0
            for k in np.flatnonzero(mask):
                out.append(text[p: parts[k][0]])
                p = parts[k][1]
            gone.append(np.flatnonzero(mask).tolist())
            count.append(int((np.diff(np.concatenate([[0], mask])) == 1).sum()))
            kept.append("".join(out) + text[p:])
        return batch(doc_id=b.column("doc_id"), n_sentences=b.column("n"), removed=(gone, pa.list_(pa.int32())), n_spans=(count, pa.int64()), kept=(kept, pa.string()))

    return map_arrow(marked, drop, "doc_id long, n_sentences long, removed array<int>, n_spans long, kept string", rows=256)


def digests(out: DataFrame) -> DataFrame:
    return out.select(
        "doc_id", "n_sentences", F.size("removed").cast("long").alias("n_removed"), "n_spans",
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"),
    )
