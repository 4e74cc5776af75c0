"""Suffix-array dedup: bytes covered by a long string that also starts elsewhere, from a collection's Burrows-Wheeler order that
is built column by column.

Which strings have to be compared: each window of ``length`` bytes is known by the smallest hash of its 16-byte pieces; consecutive
windows with the same smallest piece form a segment.  Equal windows have equal smallest pieces, so a piece that occurs in one
segment only settles its windows, and the segments of all other pieces meet by a shuffle on the piece.  Equal segments are one member
with a count before their text is moved.

How they are compared: the members of a bucket are one collection.  Its symbols are a fifth of a window wide, so a member is as many
documents as a symbol has bytes, one for each phase.  Each round inserts one symbol of every document that still has one, from the last to the first: the
place of symbol ``c`` before a suffix of rank ``r`` follows from the symbols smaller than ``c`` and the occurrences of ``c`` in the
transform before ``r`` (one sorted column holds both), and the columns of the order are rewritten in one sequential merge.  Beside
them runs the column of common prefixes, capped at the window length: whether a suffix shares a whole window with its predecessor.
After the last round a window is repeated if it shares with a neighbour or its member's count is over one.

A piece with more than ``hot_members`` different segments (the edges of a passage that very many documents share) would make one
large collection; its windows are counted one by one, spread by the window's own 128-bit hash.

Edge cases: null and empty texts have no bytes and lose none; texts shorter than ``length`` lose none; repeated rows are copies
of each other, as are rows with equal text; ids may be null or repeated; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch, map_arrow, ship, stored

PIECE = 16
#: A symbol of the collection is this share of the window.
STEPS = 5
A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on (zeros after the end) as one number."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data), "<u8", padded, strides=(1,)).astype(np.uint64)


def _names(data: np.ndarray, width: int) -> np.ndarray:
    """Number of the ``width`` bytes (a multiple of 8) from each place on (zeros after the end): equal numbers for equal bytes alone.
    Places are ordered by a hash of their bytes; neighbours of one hash are told apart by the bytes themselves."""
    words = np.concatenate([_words(data), np.zeros(width, np.uint64)])
    n, parts = len(data), range(0, width, 8)
    h = np.zeros(n, np.uint64)
    for k in parts:
        h = (h ^ (words[k: k + n] * A)) * B
        h ^= h >> np.uint64(31)
    order = np.argsort(h)
    for keys in ((), [words[k: k + n] for k in parts]):
        if len(keys):  # two different strings of one hash: in the order of their bytes' words instead
            order = np.lexsort(keys)
        one, two = order[:-1], order[1:]
        same = h[one] == h[two]
        at = np.flatnonzero(same)
        equal = np.ones(len(at), bool)
        for k in parts:
            equal &= words[one[at] + k] == words[two[at] + k]
        if len(keys) or equal.all():
            break
    same[at] = equal
    names = np.empty(n, np.uint32)
    names[order] = np.concatenate([[0], np.cumsum(~same)])[:n]
    return names


def segments(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(piece hash, first window, windows, places of the piece) of each segment; a segment has at most ``length`` windows.
    A segment that holds its piece at several places can repeat a window of its own."""
    data = np.frombuffer(text, np.uint8)
    if len(data) < length:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    w = _words(data)
    n = len(data) - PIECE + 1
    h = (w[:n] * A) ^ ((w[8: 8 + n] + C) * B)
    h ^= h >> np.uint64(32)
    h *= C
    h ^= h >> np.uint64(29)
    span, have, low = length - PIECE + 1, 1, h
    while have * 2 <= span:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if span > have:
        low = np.minimum(low[: have - span], low[span - have:])
    change = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1, [len(low)]])
    runs = np.diff(change)
    if runs.max() > length:  # the same piece again and again: cut into bounded segments
        change = np.unique(np.concatenate([change, *(np.arange(s, s + r, length) for s, r in zip(change[:-1], runs) if r > length)]))
    m, first, runs = low[change[:-1]], change[:-1], np.diff(change)
    places = np.ones(len(m), np.int64)
    small = np.sort(h[h <= m.max()])
    for k in np.flatnonzero(np.isin(m, small[1:][small[1:] == small[:-1]])).tolist():  # pieces that the text holds again
        places[k] = np.count_nonzero(h[first[k]: first[k] + runs[k] + span - 1] == m[k])
    return m, first, runs, places


def repeated_windows(members: list[bytes], counts: np.ndarray, length: int) -> list[np.ndarray]:
    """For each member a mask over its windows: does the window start anywhere else in the collection?"""
    width = length // STEPS
    sizes = np.array([len(m) for m in members], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    names = _names(np.frombuffer(b"".join(members), np.uint8), width)
    # documents: (member, phase); left[d] symbols remain to be inserted
    member = np.repeat(np.arange(len(members)), width)
    phase = np.tile(np.arange(width), len(members))
    left = (sizes[member] - phase) // width
    docs = len(member)
    base = starts[member] + phase
    ends = np.repeat(starts[1:], sizes)
    # the order: key = (symbol name + 1, rank of the rest), at = place of the suffix in the text; empty suffixes come first
    key, at, common = np.arange(docs, dtype="<u8"), np.full(docs, -1, np.int32), np.zeros(docs, bool)
    rank = np.arange(docs, dtype=np.uint32)
    left_now, round_ = left.copy(), 0
    while True:
        round_ += 1
        live = np.flatnonzero(left_now > 0)
        if not len(live):
            break
        place = base[live] + width * (left_now[live] - 1)
        left_now[live] -= 1
        new = ((names[place].astype("<u8") + np.uint64(1)) << np.uint64(32)) | rank[live]
        order = np.argsort(new)  # no two are equal: ranks differ
        new, place, live = new[order], place[order], live[order]
        fresh = np.searchsorted(key, new) + np.arange(len(new))
        # one sequential merge of the columns; ranks of the rests move with the insertions
        size = len(key) + len(new)
        kept = np.ones(size, bool)
        kept[fresh] = False
        moved = np.flatnonzero(kept).astype(np.uint32)
        for column, rests in ((key, docs), (new, 0)):  # empty suffixes have no rest; they stay first
            low = column.view("<u4")[::2][rests:]
            low[:] = moved[low]
        key2, at2, common2 = np.empty(size, "<u8"), np.empty(size, np.int32), np.zeros(size, bool)
        key2[kept], at2[kept], common2[kept] = key, at, common
        key2[fresh], at2[fresh] = new, place
        if round_ >= STEPS:  # only now are there suffixes as long as a window
            near = np.zeros(size + 1, bool)
            near[fresh] = near[fresh + 1] = True
            there = np.flatnonzero(near[:size])
            common2[there] = _share(names, key2, at2, there, width, ends)
        rank = moved[rank]
        rank[live] = fresh
        key, at, common = key2, at2, common2
    repeated = np.zeros(len(names), bool)
    both = np.flatnonzero(common)
    repeated[at[both]] = True
    repeated[at[both - 1]] = True
    return [repeated[starts[k]: starts[k] + max(0, sizes[k] - length + 1)] | bool(counts[k] > 1) for k in range(len(members))]


def _share(names, key, at, there, width, ends) -> np.ndarray:
    """Does the suffix at each rank share a whole window with the one before it?"""
    out = np.zeros(len(there), bool)
    a, b = at[there - 1], at[there]
    live = np.flatnonzero((there > 0) & (a >= 0) & (b >= 0) & ((key[there] >> np.uint64(32)) == (key[there - 1] >> np.uint64(32))))
    for t in range(1, STEPS - 1):
        # names differ where the windows do; places beyond the joined text are caught below
        p, q = a[live] + t * width, b[live] + t * width
        inside = np.maximum(p, q) < len(names)
        live = live[inside]
        live = live[names[p[inside]] == names[q[inside]]]
    live = live[(a[live] + STEPS * width <= ends[a[live]]) & (b[live] + STEPS * width <= ends[b[live]])]
    live = live[names[a[live] + (STEPS - 1) * width] == names[b[live] + (STEPS - 1) * width]]
    out[live] = True
    return out


def duplicate_spans(docs: DataFrame, length: int = 200, bucket_bytes: int = 1 << 19, hot_members: int = 20_000, carry: bool = False) -> DataFrame:
    """``doc_id, text, spans``: for each document the maximal byte runs ``[start, end)`` to remove.  ``carry`` adds a column ``rest``
    with the row's columns other than the text."""
    if length % (8 * STEPS) or length < 2 * PIECE:
        raise ValueError(f"length must be a multiple of {8 * STEPS}")
    spark = docs.sparkSession
    ship(spark)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def pieces(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [segments(t.encode("utf-8", "replace"), length) for t in b.column("text").to_pylist()]
        m, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
        n = np.bincount(at, np.concatenate([f[3] for f in found]), minlength=len(m))
        return batch(m=pa.array(m.view(np.int64)), n=pa.array(n.astype(np.int64)))

    def occurrences(b: pa.RecordBatch) -> pa.RecordBatch:
        ms, ids, rows, at, size, c1, c2 = [], [], [], [], [], [], []
        for doc, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            raw = t.encode("utf-8", "replace")
            m, s, n, _ = segments(raw, length)
            if len(m):
                row = xxhash.xxh3_64_intdigest(raw)
                h = b"".join(xxhash.xxh3_128_digest(raw[i: i + k]) for i, k in zip(s.tolist(), (n + length - 1).tolist()))
                h = np.frombuffer(h, "<i8").reshape(-1, 2)
                ms.append(m.view(np.int64)), at.append(s), size.append(n + length - 1), c1.append(h[:, 0]), c2.append(h[:, 1])
                ids += [doc] * len(m)
                rows.append(np.full(len(m), row, np.uint64).view(np.int64))
        if not ms:
            return None
        cat = lambda x, t: pa.array(np.concatenate(x).astype(t))
        return batch(doc_id=(ids, pa.int64()), row=cat(rows, np.int64), m=cat(ms, np.int64), c1=cat(c1, np.int64), c2=cat(c2, np.int64), at=cat(at, np.int32), size=cat(size, np.int32))

    # pieces that more than one window class can hold: found in several segments or several times in one
    shared = map_arrow(d.select("text"), pieces, "m long, n long", rows=2048).groupBy("m").agg(F.sum("n").alias("n")).filter("n > 1").select(F.col("m").alias("_m"))
    occ = map_arrow(d, occurrences, "doc_id long, row long, m long, c1 long, c2 long, at int, size int")
    occ = stored(occ.join(shared, F.col("m") == F.col("_m"), "left_semi"), "suffix-occ")
    # equal segments become one member, whose text one of its places provides
    members = occ.groupBy("m", "c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "row", "at", "size")).alias("p"))
    members = members.select("m", "c1", "c2", "n", "p.*")
    wanted = members.groupBy("doc_id", "row").agg(F.collect_list(F.struct("m", "c1", "c2", "n", "at", "size")).alias("parts"))  # as many as a text has segments
    wanted = wanted.withColumnsRenamed({"doc_id": "_d", "row": "_r"})

    def key(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [xxhash.xxh3_64_intdigest(t.encode("utf-8", "replace")) for t in b.column("text").to_pylist()]
        return batch(**{c: b.column(c) for c in b.schema.names}, row=pa.array(np.array(rows, np.uint64).view(np.int64)))

    def keyed_by_row(frame: DataFrame) -> DataFrame:
        return map_arrow(frame, key, T.StructType([*frame.schema.fields, T.StructField("row", T.LongType())]))

    keyed = keyed_by_row(d)
    match = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("row") == F.col("_r"))
    raw = F.col("text").cast("binary")
    cuts = keyed.join(wanted, match).select(F.col("text"), F.explode("parts").alias("p"))
    cuts = cuts.select("p.m", "p.c1", "p.c2", "p.n", F.substring(raw, F.col("p.at") + 1, F.col("p.size")).alias("body"))
    cuts = stored(cuts, "suffix-members")  # rows repeated with id and text provide a member twice; the second is left out below
    total = cuts.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    hot = cuts.groupBy("m").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > hot_members).select(F.col("m").alias("_m"))
    hot = stored(hot, "suffix-hot")
    cold = cuts.join(hot, F.col("m") == F.col("_m"), "left_anti").withColumn("bucket", F.pmod(F.xxhash64("m"), F.lit(buckets)))
    spans = "m long, c1 long, c2 long, spans array<struct<s:int,e:int>>"
    kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))

    def construct(t: pa.Table) -> pa.Table:
        first = {k: i for i, k in reversed(list(enumerate(zip(*(t.column(c).to_pylist() for c in ("m", "c1", "c2"))))))}
        t = t.take(pa.array(sorted(first.values()), pa.int64()))
        found = repeated_windows(t.column("body").to_pylist(), t.column("n").to_numpy(), length)
        runs = [_runs(x, length) for x in found]
        return pa.table({"m": t.column("m"), "c1": t.column("c1"), "c2": t.column("c2"), "spans": pa.array(runs, kind)})

    done = cold.groupBy("bucket").applyInArrow(construct, spans)
    warm = cuts.join(hot, F.col("m") == F.col("_m"), "left_semi").dropDuplicates(["m", "c1", "c2"]).select("m", "c1", "c2", "n", "body", F.explode(F.sequence(F.lit(1), F.octet_length("body") - length + 1)).alias("o"))
    window = F.substring("body", F.col("o"), length)
    warm = warm.select("m", "c1", "c2", "n", "o", F.xxhash64(window).alias("w1"), F.xxhash64(F.lit(1), window).alias("w2"))
    again = warm.groupBy("w1", "w2").agg(F.sum("n").alias("k")).filter("k > 1").select(F.col("w1").alias("_1"), F.col("w2").alias("_2"))
    warm = warm.join(again, (F.col("w1") == F.col("_1")) & (F.col("w2") == F.col("_2")))
    warm = warm.groupBy("m", "c1", "c2").agg(F.transform(F.array_sort(F.collect_list("o")), lambda o: F.struct((o - 1).alias("s"), (o - 1 + length).cast("int").alias("e"))).alias("spans"))
    done = stored(done.unionByName(warm).filter(F.size("spans") > 0).withColumnsRenamed({"m": "_m", "c1": "_c1", "c2": "_c2"}), "suffix-spans")
    back = occ.join(done, (F.col("m") == F.col("_m")) & (F.col("c1") == F.col("_c1")) & (F.col("c2") == F.col("_c2")))
    # all spans of one document, as many as it has segments; a repeated row brings each of them again
    cover = stored(back.groupBy("doc_id", "row").agg(F.collect_set(F.struct("at", "spans")).alias("parts")).withColumnsRenamed({"doc_id": "_d", "row": "_r"}), "suffix-cover")
    if carry:
        rest = F.struct(*(F.col(c) for c in docs.columns if c != "text")).alias("rest")
        keyed = keyed_by_row(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), rest))
    marked = keyed.join(cover, match, "left").select("doc_id", "text", *(["rest"] if carry else []), "parts")

    def unite(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for parts in b.column("parts").to_pylist():
            ends: list[list[int]] = []
            for s, e in sorted((x["s"] + p["at"], x["e"] + p["at"]) for p in parts or () for x in p["spans"]):
                if ends and ends[-1][1] >= s:
                    ends[-1][1] = max(ends[-1][1], e)
                else:
                    ends.append([s, e])
            out.append([{"s": s, "e": e} for s, e in ends])
        return batch(**{c: b.column(c) for c in b.schema.names if c != "parts"}, spans=(out, kind))

    out = T.StructType([*marked.drop("parts").schema.fields, T.StructField("spans", T.DataType.fromDDL("array<struct<s:int,e:int>>"))])
    return map_arrow(marked, unite, out, rows=256)


def _runs(mask: np.ndarray, length: int) -> list[dict]:
    """Byte runs covered by the marked windows."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    out: list[dict] = []
    for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
        if out and out[-1]["e"] >= s:
            out[-1]["e"] = e - 1 + length
        else:
            out.append({"s": s, "e": e - 1 + length})
    return out


def remaining(text: str, spans) -> bytes:
    """The text's bytes without the spans."""
    raw, out, p = text.encode("utf-8", "replace"), [], 0
    for s, e in spans:
        out.append(raw[p:s])
        p = e
    return b"".join([*out, raw[p:]])


def remove_spans(found: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (binary: cuts may fall inside a character)."""

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        n, gone, k, kept = [], [], [], []
        for t, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
            pairs = [(x["s"], x["e"]) for x in spans]
            kept.append(remaining(t, pairs))
            gone.append(sum(e - s for s, e in pairs))
            n.append(len(kept[-1]) + gone[-1])
            k.append(len(pairs))
        return batch(doc_id=b.column("doc_id"), n_bytes=(n, pa.int64()), n_removed=(gone, pa.int64()), n_spans=(k, pa.int64()), kept=(kept, pa.binary()))

    return map_arrow(found, cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary", rows=256)


def clean(docs: DataFrame, length: int = 200) -> DataFrame:
    """The documents, all columns as they were, with the repeated bytes taken out of ``text`` (what is left of a cut character goes
    too) and ``n_chars``, where there is one, counted anew; documents that lose all their words go."""
    found = duplicate_spans(docs, length, carry=True)

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        texts, there = [], []
        for t, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
            kept = remaining(t, [(x["s"], x["e"]) for x in spans]).decode("utf-8", "ignore") if spans else t
            texts.append(kept)
            there.append(not spans or bool(kept.split()))
        out = batch(rest=b.column("rest"), text=(texts, pa.string()))
        return out.filter(pa.array(there, pa.bool_()))

    schema = T.StructType([found.schema["rest"], T.StructField("text", T.StringType())])
    new = map_arrow(found.select("rest", "text", "spans"), cut, schema, rows=256)
    columns = [F.col("text") if c == "text" else F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("rest").getField(c).alias(c) for c in docs.columns]
    return new.select(*columns)


def digests(cut: DataFrame) -> DataFrame:
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
