"""Katz backoff language model: Good-Turing discounted n-gram counts, exactly normalised backoff weights.

Vocabulary.  Every training word and the end of a text are words of the model, with n-grams of their own; all words that no training
text holds are one further outcome.  Counts cover every token of every training text.

Tables.  Texts are encoded once into chunks of whole texts (numbers of the chunk's own words, which are in the order of their CRC-32).
Each chunk deals its words out to parts by CRC-32 and its distinct bigrams by their history, one packed row for each part.  Where a
part meets them, their counts are added up and stored: a part's distinct words with their counts are a row of the table of order 1,
its bigrams one of order 2.  Words are numbered by falling count, so that the counts are known from the numbers by a list of the
distinct counts (at most sqrt(2 x tokens) of them).  A history among the first ``hot`` numbers is dealt out by its bigrams
instead, so that any other history has at most ``HISTORY`` tokens; what its parts count is added up once more.
For counts up to ``cutoff`` the Good-Turing discount applies where it lies between 0 and 1, else half a count is taken off; a
history without any discounted mass gets one more count in its denominator.  The backoff weight of a history is the mass left over
divided by the lower-order mass of the words never seen after it, so that the probabilities of all words after any history
add up to one.  ``Model.write`` unpacks the whole model into a table partitioned by order.

Scoring.  A part answers each request with the counts of the bigrams, the denominators of their histories, and the weights of those
that have to back off, all in the order of the request.  A chunk evaluates each of its bigrams from the longest order down: the
discounted share of a seen bigram, else the history's weight times the word's own probability; a word after an unknown one has its
own probability.

Edge cases: null and empty texts are the end token alone; with nothing to learn from every probability is 1; repeated rows are
scored row by row; null ids count as training rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, lower_words, map_arrow, ship, slices, stored

BOS, UNK, FIRST = 0, 1, 2  # numbers: the begin of a text (history only), any unknown word; known words by falling count
HISTORY = 4_000_000  # tokens of a history that one part may hold
CHUNK = "chunk long, words binary, ids binary, n_words int, docs array<long>, train array<boolean>, sizes array<int>"
ASK_WORDS = "part int, chunk long, words binary, n binary"
WORD_PART = "part int, words binary, n binary, chunks array<long>, sizes array<int>, at binary, groups array<struct<c:long,k:long>>"
ASK_GRAMS = "part int, chunk long, h binary, w binary, n binary"
GRAM_PART = ("part int, h binary, w binary, n binary, chunks array<long>, sizes array<int>, at binary, "
             "n_r array<long>, hot array<struct<h:long,small:array<long>,big:long,covered:double>>")
REPLY = "chunk long, part int, a binary, den binary, bow binary"  # part below zero: -1 - part of words


def squeeze(values: np.ndarray, kind: str = "<i8") -> bytes:
    """Numbers as their number and compressed byte planes."""
    a = np.ascontiguousarray(values, kind)
    head = len(a).to_bytes(8, "little")
    return head + pa.Codec("zstd", 1).compress(a.view(np.uint8).reshape(len(a), -1).T.tobytes(), asbytes=True) if len(a) else head


def expand(packed: bytes, kind: str = "<i8") -> np.ndarray:
    n, size = int.from_bytes(packed[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    raw = pa.Codec("zstd").decompress(packed[8:], n * size, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).ravel()


def runs(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    n = len(sorted_columns[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.any([np.diff(x) != 0 for x in sorted_columns], axis=0)
    return np.flatnonzero(new)


def chunks(docs: DataFrame, train, chunk_tokens: int) -> DataFrame:
    """The texts as chunk rows: the chunk's words by CRC-32, first the empty one, the end of text; the tokens as numbers of those words."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", train.alias("train"))

    def run(batches):
        state = {"known": {}, "ids": [], "docs": [], "train": [], "sizes": [], "n": 0}

        def flush():
            words = [b"", *state["known"]]
            order = np.argsort([zlib.crc32(w) for w in words], kind="stable")  # that of the empty word is zero
            place = np.empty(len(words), np.int32)
            place[order] = np.arange(len(words))
            ids = place[np.concatenate([np.append(x, 0) for x in state["ids"]])]
            out = batch(
                chunk=([uuid.uuid4().int >> 65], pa.int64()), words=([zlib.compress(b"\n".join(words[i] for i in order), 1)], pa.binary()), ids=([squeeze(ids, "<i4")], pa.binary()),
                n_words=([len(words)], pa.int32()), docs=([state["docs"]], pa.list_(pa.int64())), train=([state["train"]], pa.list_(pa.bool_())), sizes=([state["sizes"]], pa.list_(pa.int32())))
            state.update(known={}, ids=[], docs=[], train=[], sizes=[], n=0)
            return out

        for whole in batches:
            for b in slices(whole, 256):
                for doc, text, learn in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "train"))):
                    known, words = state["known"], lower_words(text)
                    state["ids"].append(np.fromiter((known.setdefault(w, len(known) + 1) for w in words), np.int32, len(words)))
                    state["docs"].append(doc), state["train"].append(learn), state["sizes"].append(len(words) + 1)
                    state["n"] += len(words) + 1
                    if state["n"] >= chunk_tokens:
                        yield flush()
        if state["n"]:
            yield flush()

    return d.mapInArrow(run, CHUNK)


class Chunk:
    """One chunk row as arrays, without its words."""

    def __init__(self, row: dict):
        self.name = row["chunk"]
        self.n_words, self.docs, self.train, self.sizes = row["n_words"], row["docs"], np.array(row["train"], bool), np.array(row["sizes"], np.int64)
        self.ids = expand(row["ids"], "<i4")
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        self.learn = np.repeat(self.train, self.sizes)

    def numbers(self, replies: pa.Table) -> np.ndarray:
        """The model's number of each of the chunk's words: parts are ranges of them."""
        found = sorted((-1 - p, a) for p, a in zip(*(replies.column(x).to_pylist() for x in ("part", "a"))) if p < 0)
        return np.concatenate([expand(a) for _, a in found])

    def bigrams(self, numbers: np.ndarray, parts: int, hot: int):
        """The chunk's bigrams: history, word, part, training count; the order by (part, history, word) in which those with a known
        history are asked for; the bigram that ends at each token."""
        width = self.n_words + 1
        before = np.concatenate([[0], self.ids[:-1]]).astype(np.int64)
        before[self.starts] = width - 1
        keys, at = np.unique(before * width + self.ids, return_inverse=True)
        n = np.bincount(at[self.learn], minlength=len(keys))
        numbers = np.append(numbers, BOS)
        h, w = numbers[keys // width], numbers[keys % width]
        part = deal(h, w, parts, hot)
        asked = np.flatnonzero(h != UNK)
        return h, w, part, n, asked[np.lexsort((w[asked], h[asked], part[asked]))], at


def deal(h: np.ndarray, w: np.ndarray, parts: int, hot: int) -> np.ndarray:
    """Part of a bigram: by its history, by history and word if the history is hot."""
    x = h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.where(h < hot, w, 0).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return ((x >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)


def ask_words(encoded: DataFrame, parts: int) -> DataFrame:
    """Each chunk's words with their training counts, one packed request for each part."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        row = b.to_pylist()[0]
        c, words = Chunk(row), zlib.decompress(row["words"]).split(b"\n")
        n = np.bincount(c.ids[c.learn], minlength=c.n_words)
        part = (np.array([zlib.crc32(w) for w in words], np.uint64) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
        at = runs(part)
        cuts = list(zip(at, [*at[1:], len(words)]))
        return batch(part=(part[at], pa.int32()), chunk=([c.name] * len(cuts), pa.int64()), words=([zlib.compress(b"\n".join(words[i:j]), 1) for i, j in cuts], pa.binary()),
                     n=([squeeze(n[i:j], "<i4") for i, j in cuts], pa.binary()))

    return map_arrow(encoded, run, ASK_WORDS, rows=1)


def merged_words(requests: DataFrame) -> DataFrame:
    """The requests of a part as one row: its training words by falling count, which of them each request asked for (-1: none), and how
    many words have each count."""

    def run(t: pa.Table) -> pa.Table:
        lists = [zlib.decompress(w).split(b"\n") for w in t.column("words").to_pylist()]
        found = pa.array([w for x in lists for w in x], pa.binary()).dictionary_encode()
        at, words = found.indices.to_numpy(), found.dictionary.to_pylist()
        n = np.bincount(at, np.concatenate([expand(x, "<i4") for x in t.column("n").to_pylist()]), len(words)).astype(np.int64)
        order = np.argsort(-n, kind="stable")[: np.count_nonzero(n)]
        place = np.full(len(words), -1, np.int32)
        place[order] = np.arange(len(order))
        falling = n[order]
        heads = runs(falling)
        groups = [{"c": int(c), "k": int(k)} for c, k in zip(falling[heads], np.diff([*heads, len(falling)]))]
        return pa.Table.from_batches([batch(
            part=([t.column("part")[0].as_py()], pa.int32()), words=([zlib.compress(b"\n".join(words[i] for i in order), 1)], pa.binary()), n=([squeeze(falling)], pa.binary()),
            chunks=([t.column("chunk").to_pylist()], pa.list_(pa.int64())), sizes=([[len(x) for x in lists]], pa.list_(pa.int32())),
            at=([squeeze(place[at], "<i4")], pa.binary()), groups=([groups], pa.list_(pa.struct([("c", pa.int64()), ("k", pa.int64())]))))])

    return requests.groupBy("part").applyInArrow(run, WORD_PART)


def with_numbers(words: DataFrame, one) -> DataFrame:
    """The parts of words with ``bases``: the first number of each of a part's counts, falling.  The words of one count are numbered part
    after part."""
    first = words.sparkSession.createDataFrame([(int(c), int(i)) for c, i in zip(one.count[1:], one.first[1:])], "c long, first long")
    each = words.select("part", F.explode("groups").alias("g")).select("part", "g.c", "g.k").join(F.broadcast(first), "c")  # sqrt(2 x tokens) rows
    before = F.sum("k").over(Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    each = each.withColumn("base", F.col("first") + F.coalesce(before, F.lit(0)))
    bases = each.groupBy(F.col("part").alias("_part")).agg(F.sort_array(F.collect_list(F.struct("c", "k", "base")), asc=False).alias("bases"))
    return words.join(bases, F.col("part") == F.col("_part"), "left").drop("_part", "groups")


def numbers_of(row: dict) -> np.ndarray:
    """The numbers of a part's words, in their order, and that of an unknown word at the end."""
    return np.concatenate([*(g["base"] + np.arange(g["k"]) for g in row["bases"] or []), [UNK]]).astype(np.int64)


def word_replies(numbered: DataFrame) -> DataFrame:
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        row = b.to_pylist()[0]
        asked, ends = numbers_of(row)[expand(row["at"], "<i4")], np.cumsum(row["sizes"])
        packed = [squeeze(asked[j - n : j]) for j, n in zip(ends, row["sizes"])]
        return batch(chunk=(row["chunks"], pa.int64()), part=([-1 - row["part"]] * len(packed), pa.int32()), a=(packed, pa.binary()), den=([None] * len(packed), pa.binary()),
                     bow=([None] * len(packed), pa.binary()))

    return map_arrow(numbered, run, REPLY, rows=1)


def discounts(n_r: dict[int, int], cutoff: int) -> dict[int, float]:
    """Katz's factor for each count up to ``cutoff``."""
    ratio = (cutoff + 1) * n_r.get(cutoff + 1, 0) / n_r[1] if n_r.get(1) else 0.0
    out = {}
    for r in range(1, cutoff + 1):
        d = None
        if n_r.get(r) and n_r.get(r + 1) and ratio < 1:
            d = ((r + 1) * n_r[r + 1] / (r * n_r[r]) - ratio) / (1 - ratio)
        out[r] = d if d is not None and 0 < d < 1 else (r - 0.5) / r
    return out


def denominator(total, kept):
    return np.where(kept < total * (1 - 1e-9), total, total + 1)


class Unigrams:
    """Order 1 by rank: the distinct counts with the first number of each, the probabilities, and the mass of unknown words."""

    def __init__(self, counts: dict[int, int], cutoff: int):
        falling = sorted(counts, reverse=True)
        self.count = np.array([0, *falling], np.int64)
        self.first = np.cumsum([0, FIRST, *(counts[c] for c in falling[:-1])][: len(falling) + 1])  # below the first known word: count 0
        self.tokens, self.types = sum(c * k for c, k in counts.items()), sum(counts.values())
        factor = discounts(counts, cutoff)
        kept = np.array([factor.get(int(c), 1.0) * c for c in self.count])
        mass = float(sum(k * counts.get(int(c), 0) for c, k in zip(self.count, kept)))
        den = float(denominator(self.tokens, mass))
        self.unknown = 1 - mass / den  # the probability of all unknown words together
        self.p = kept / den
        self.p[0] = self.unknown

    def at(self, numbers: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, numbers, "right") - 1

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        return self.count[self.at(numbers)]

    def probability(self, numbers: np.ndarray) -> np.ndarray:
        return self.p[self.at(numbers)]


def ask_grams(encoded: DataFrame, numbered: DataFrame, parts: int, hot: int) -> DataFrame:
    """Each chunk's bigrams, one packed request for each part."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        c = Chunk(left.to_pylist()[0])
        h, w, part, n, order, _ = c.bigrams(c.numbers(right), parts, hot)
        h, w, part, n = h[order], w[order], part[order], n[order]
        at = runs(part)
        cuts = list(zip(at, [*at[1:], len(part)]))
        return pa.Table.from_batches([batch(
            part=(part[at], pa.int32()), chunk=([c.name] * len(cuts), pa.int64()), h=([squeeze(np.diff(h[i:j], prepend=0)) for i, j in cuts], pa.binary()),
            w=([squeeze(w[i:j]) for i, j in cuts], pa.binary()), n=([squeeze(n[i:j], "<i4") for i, j in cuts], pa.binary()))])

    return encoded.groupBy("chunk").cogroup(numbered.groupBy("chunk")).applyInArrow(run, ASK_GRAMS)


def merged_grams(requests: DataFrame, one, cutoff: int, hot: int) -> DataFrame:
    """The requests of a part as one row: its distinct bigrams with their counts, which of them each request asked for, in order,
    and what it adds to the counts of counts and to the sums of hot histories."""

    def run(t: pa.Table) -> pa.Table:
        column = lambda x, kind="<i8": [expand(b, kind) for b in t.column(x).to_pylist()]
        h = [np.cumsum(x) for x in column("h")]
        sizes = [len(x) for x in h]
        h, w, n = np.concatenate(h), np.concatenate(column("w")), np.concatenate(column("n", "<i4")).astype(np.int64)
        order = np.lexsort((w, h))
        h, w, n = h[order], w[order], n[order]
        heads = runs(h, w)
        at = np.empty(len(h), np.int32)
        at[order] = np.repeat(np.arange(len(heads)), np.diff([*heads, len(h)]))
        h, w, n = h[heads], w[heads], np.add.reduceat(n, heads)
        n_r = np.bincount(np.minimum(n, cutoff + 2), minlength=cutoff + 3)[1 : cutoff + 2]
        of_hot = (n > 0) & (h < hot)
        names, to = np.unique(h[of_hot], return_inverse=True)
        some, size = n[of_hot], len(names)
        small = np.stack([np.bincount(to[some == r], minlength=size) for r in range(1, cutoff + 1)], 1)
        big = np.bincount(to, np.where(some > cutoff, some, 0), size).astype(np.int64)
        covered = np.bincount(to, one.value.probability(w[of_hot]), size)
        sums = [{"h": int(a), "small": b.tolist(), "big": int(c), "covered": float(d)} for a, b, c, d in zip(names, small, big, covered)]
        struct = pa.struct([("h", pa.int64()), ("small", pa.list_(pa.int64())), ("big", pa.int64()), ("covered", pa.float64())])
        return pa.Table.from_batches([batch(
            part=([t.column("part")[0].as_py()], pa.int32()), h=([squeeze(np.diff(h, prepend=0))], pa.binary()), w=([squeeze(w)], pa.binary()), n=([squeeze(n)], pa.binary()),
            chunks=([t.column("chunk").to_pylist()], pa.list_(pa.int64())), sizes=([sizes], pa.list_(pa.int32())), at=([squeeze(at, "<i4")], pa.binary()),
            n_r=([n_r.tolist()], pa.list_(pa.int64())), hot=([sums], pa.list_(struct)))])

    return requests.groupBy("part").applyInArrow(run, GRAM_PART)


class Weights:
    """What a part needs beside its own counts: order 1, the discount factors, denominators and weights of hot histories."""

    def __init__(self, one: Unigrams, factor: dict[int, float], hot: int):
        self.one, self.factor, self.hot = one, factor, hot
        self.den, self.bow = np.ones(hot), np.ones(hot)

    def close(self, total, kept, covered):
        """Denominator and backoff weight; unknown words are never covered, so their mass is the least that is left."""
        den = denominator(total, kept)
        return den, (1 - kept / den) / np.maximum(1 - covered, self.one.unknown)

    def kept(self, n: np.ndarray) -> np.ndarray:
        """Counts after the discount."""
        out = n.astype(float)
        for r, v in self.factor.items():
            out[n == r] = v * r
        return out

    def histories(self, h: np.ndarray, w: np.ndarray, n: np.ndarray):
        """The histories of a part's bigrams, with denominators and weights, and the place of each bigram's own among them."""
        names, to = np.unique(h, return_inverse=True)
        den, bow = self.close(np.bincount(to, n), np.bincount(to, self.kept(n)), np.bincount(to, np.where(n > 0, self.one.probability(w), 0)))
        known = names < self.hot
        den[known], bow[known] = self.den[names[known]], self.bow[names[known]]
        return names, den, bow, to

    def small(self) -> Weights:
        """Without the hot histories."""
        return Weights(self.one, self.factor, 0)


def bigrams_of(row: dict):
    return np.cumsum(expand(row["h"])), expand(row["w"]), expand(row["n"])


class Model:
    """A trained model: ``words`` (with the first numbers of their counts) and ``grams`` are the stored tables of orders 1 and 2, a row for
    each part, ``numbered`` the numbers of the chunks' words; ``weights`` is bounded by the distinct counts and the hot histories."""

    def __init__(self, words: DataFrame, numbered: DataFrame, grams: DataFrame, weights: Weights, parts: int):
        self.words, self.numbered, self.grams, self.weights, self.parts = words, numbered, grams, weights, parts

    def replies(self) -> DataFrame:
        """Counts, denominators and weights, one packed reply for each request."""
        sent = self.words.sparkSession.sparkContext.broadcast(self.weights)

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            row = b.to_pylist()[0]
            h, w, n = bigrams_of(row)
            _, den, bow, to = sent.value.histories(h, w, n)
            at, end, out = expand(row["at"], "<i4"), 0, {"a": [], "den": [], "bow": []}
            for size in row["sizes"]:
                asked = at[end : end + size]
                end += size
                seen, mine = n[asked], to[asked]
                heads = runs(mine)
                mine, back = mine[heads], np.logical_or.reduceat(seen == 0, heads)
                out["a"].append(squeeze(seen)), out["den"].append(squeeze(den[mine])), out["bow"].append(squeeze(bow[mine[back]], "<f8"))
            return batch(chunk=(row["chunks"], pa.int64()), part=([row["part"]] * len(row["chunks"]), pa.int32()), **{k: (v, pa.binary()) for k, v in out.items()})

        return map_arrow(self.grams, run, REPLY, rows=1)

    def write(self, path: str) -> None:
        """The model as a table ``history, word, number, count, logp, bow`` partitioned by order; order 1 has a row for unknown words (no
        word, number 1) and one for the begin of a text (number 0, no probability)."""
        spark, weights = self.words.sparkSession, self.weights
        sent = spark.sparkContext.broadcast(weights)

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            h, w, n = bigrams_of(b.to_pylist()[0])
            names, den, bow, to = sent.value.histories(h, w, n)
            s, own = n > 0, names >= sent.value.hot
            logp = np.log10(sent.value.kept(n[s]) / den[to[s]])
            history = np.concatenate([h[s], names[own]])
            second = np.concatenate([np.ones(s.sum(), bool), np.zeros(own.sum(), bool)])
            fill = lambda x, y, kind: pa.array(np.concatenate([x, y]), kind)
            return batch(history=(history, pa.int64()), number=fill(w[s], np.zeros(own.sum(), np.int64), pa.int64()), count=fill(n[s], np.zeros(own.sum(), np.int64), pa.int64()),
                         value=fill(logp, np.log10(bow[own]), pa.float64()), second=(second, pa.bool_()))

        rows = stored(map_arrow(self.grams, run, "history long, number long, count long, value double, second boolean", rows=1), "katz-rows")
        hot = spark.createDataFrame([(i, float(np.log10(x))) for i, x in enumerate(weights.bow)], "_h long, bow double")
        bow = rows.filter("not second").select(F.col("history").alias("_h"), F.col("value").alias("bow")).unionByName(hot)

        def p1(b: pa.RecordBatch) -> pa.RecordBatch:
            row = b.to_pylist()[0]
            number, n = numbers_of(row)[:-1], expand(row["n"])
            words = zlib.decompress(row["words"]).split(b"\n") if len(n) else []
            return batch(word=(words, pa.binary()), c=(n, pa.int64()), number=(number, pa.int64()), logp=(np.log10(sent.value.one.probability(number)), pa.float64()))

        known = map_arrow(self.words, p1, "word binary, c long, number long, logp double", rows=1)
        known = known.unionByName(spark.createDataFrame([(None, 0, UNK, float(np.log10(weights.one.unknown))), (None, 0, BOS, None)], known.schema))
        one = known.join(bow, F.col("number") == F.col("_h"), "left").select(
            F.lit(None).cast("long").alias("history"), "word", "number", F.col("c").alias("count"), "logp", "bow", F.lit(1).alias("order"))
        two = rows.filter("second").select(
            "history", F.lit(None).cast("binary").alias("word"), "number", "count", F.col("value").alias("logp"), F.lit(None).cast("double").alias("bow"), F.lit(2).alias("order"))
        one.unionByName(two).write.partitionBy("order").parquet(path)


def train(encoded: DataFrame, cutoff: int = 5, part_tokens: int = 1_000_000, hot: int = 4096) -> Model | None:
    """Count, discount and normalise.  A part holds the bigrams of about ``part_tokens`` tokens; at least ``hot`` of the most frequent
    histories are dealt out by bigram.  None if there is nothing to learn from."""
    spark = encoded.sparkSession
    ship(spark)
    tokens = encoded.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // part_tokens))
    words = stored(merged_words(ask_words(encoded, parts)), "katz-words")
    groups = words.select(F.explode("groups").alias("g")).groupBy("g.c").agg(F.sum("g.k").alias("k"))
    one = Unigrams({r["c"]: r["k"] for r in groups.collect()}, cutoff)  # sqrt(2 x tokens) rows at most
    if not one.tokens:
        return None
    words = with_numbers(words, one)
    numbered = stored(word_replies(words), "katz-numbers")
    hot = max(hot, -(-tokens // HISTORY)) + FIRST  # the word of rank r has tokens / r occurrences at most
    grams = stored(merged_grams(ask_grams(encoded.drop("words"), numbered, parts, hot), spark.sparkContext.broadcast(one), cutoff, hot), "katz-grams")
    counts = grams.select(*(F.sum(F.col("n_r")[i]).alias(str(i)) for i in range(cutoff + 1))).first()
    weights = Weights(one, discounts({i + 1: counts[i] for i in range(cutoff + 1) if counts[i]}, cutoff), hot)
    sums = grams.select(F.explode("hot").alias("s")).select("s.*").groupBy("h").agg(
        F.sum("big").alias("big"), F.sum("covered").alias("covered"), *(F.sum(F.col("small")[i]).alias(f"n{i + 1}") for i in range(cutoff)))
    for r in sums.collect():  # a row for each hot history
        total = r["big"] + sum(k * r[f"n{k}"] for k in range(1, cutoff + 1))
        kept = r["big"] + sum(weights.factor[k] * k * r[f"n{k}"] for k in range(1, cutoff + 1))
        weights.den[r["h"]], weights.bow[r["h"]] = weights.close(float(total), kept, r["covered"])
    return Model(words, numbered, grams, weights, parts)


def score(docs: DataFrame, train_rows, cutoff: int = 5, chunk_tokens: int = 1_000_000, part_tokens: int = 1_000_000, hot: int = 4096) -> DataFrame:
    """``doc_id, learned, n_tokens, n_known, train_tokens, base_score, score`` of every text; the model learns from the rows where
    the column ``train_rows`` is true."""
    spark = docs.sparkSession
    ship(spark)
    encoded = stored(chunks(docs, train_rows, chunk_tokens), "katz-chunks")
    model = train(encoded, cutoff, part_tokens, hot)
    weights, parts, hot = (model.weights, model.parts, model.weights.hot) if model else (Weights(Unigrams({}, cutoff), {}, 0), 1, FIRST)
    sent = spark.sparkContext.broadcast(weights.small())
    replies = model.numbered.unionByName(model.replies()) if model else spark.createDataFrame([], REPLY)

    def evaluate(left: pa.Table, right: pa.Table) -> pa.Table:
        one = sent.value.one
        c = Chunk(left.to_pylist()[0])
        numbers = c.numbers(right) if one.tokens else np.full(c.n_words, UNK)
        counts = one.counts(numbers)[c.ids]
        add = lambda x: np.add.reduceat(x, c.starts)
        base, n_known = add(np.log10((counts + 1) / (one.tokens + one.types + 1))), add((counts > 0).astype(np.int64))
        value = np.zeros(len(c.ids))
        if one.tokens:
            h, w, part, _, order, at = c.bigrams(numbers, parts, hot)
            grams = one.probability(w)
            found = sorted(x for x in zip(*(right.column(x).to_pylist() for x in ("part", "a", "den", "bow"))) if x[0] >= 0)
            if found:
                n, den = np.concatenate([expand(x[1]) for x in found]), np.concatenate([expand(x[2]) for x in found])
                heads = runs(part[order], h[order])
                to = np.repeat(np.arange(len(heads)), np.diff([*heads, len(order)]))
                bow = np.ones(len(heads))
                bow[np.logical_or.reduceat(n == 0, heads)] = np.concatenate([expand(x[3], "<f8") for x in found])
                grams[order] = np.where(n > 0, sent.value.kept(n) / den[to], bow[to] * grams[order])
            value = np.log10(grams)[at]
        return pa.table({
            "doc_id": pa.array(c.docs, pa.int64()), "learned": pa.array(c.train), "n_tokens": pa.array(c.sizes, pa.int64()), "n_known": pa.array(n_known),
            "train_tokens": pa.array(np.full(len(c.docs), one.tokens, np.int64)), "base_score": pa.array(base), "score": pa.array(add(value)),
        })

    out = "doc_id long, learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return encoded.drop("words").groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(evaluate, out)


def learns(column: str = "doc_id", folds: int = 7, held: int = 2):
    """True for the rows to learn from: crc32 of the id as text, modulo ``folds``, is not ``held``."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds != held, F.lit(True))


def held_out_scores(docs: DataFrame, **how) -> DataFrame:
    scored = score(docs, learns(), **how)
    return scored.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
