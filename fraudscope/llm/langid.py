"""Language identification by hyperdimensional profiles.

Every letter owns a random vector of +1 and -1, made from its code point; an n-gram's vector is the product of its letters'
vectors, each rotated by its place (binding); a text's vector is the sum over its n-grams (bundling); a language's prototype is
the sum over its training texts.  A text gets the language whose prototype has the largest cosine with its vector.

Training sums n-gram counts per language in each task and adds up the partial prototypes by (language, coordinate); the driver
receives one vector per learned language, a set bounded by ``languages`` distinct labels (more raise an error).

Edge cases: a null text, or one without a letter, is ``und`` with score 0; ties go to the first language in order; null labels
teach nothing; with nothing to learn from every text is ``und``; repeated rows and ids are predicted row by row; other columns
are ignored.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, map_arrow, ship, slices, worker_cache

UND = "und"


class Space:
    """Letter and n-gram vectors of one setting; n-grams are made once per worker, up to a bound."""

    def __init__(self, size: int = 1024, n: int = 3, seed: int = 7, most: int = 30_000):
        self.size, self.n, self.seed, self.most = size, n, seed, most
        self.letters: dict[int, np.ndarray] = {}
        self.classes: dict[int, int] = {}
        self.rows: dict[int, int] = {}
        self.grid = np.zeros((most, size), np.int8)

    def letter(self, c: int) -> np.ndarray:
        if c not in self.letters:
            bits = np.random.default_rng([self.seed, c]).integers(0, 2, self.size)
            self.letters[c] = (2 * bits - 1).astype(np.int8)
        return self.letters[c]

    def grams(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams (packed code points) of the lower-cased letters, gaps as one blank, with their counts."""
        c = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
        if not len(c):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        kinds, at = np.unique(c, return_inverse=True)
        for k in kinds.tolist():
            if k not in self.classes:
                self.classes[k] = k if chr(k).isalpha() else 32
        c = np.fromiter((self.classes[k] for k in kinds.tolist()), np.int64, len(kinds))[at]
        if not (c != 32).any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        c = np.concatenate([[32], c, [32]])
        c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
        if len(c) < self.n:
            c = np.concatenate([c, np.full(self.n - len(c), 32)])
        key = np.zeros(len(c) - self.n + 1, np.int64)
        for j in range(self.n):
            key = (key << 21) | c[j: len(c) - self.n + 1 + j]
        return np.unique(key, return_counts=True)

    def vectors(self, keys: np.ndarray) -> np.ndarray:
        """One int8 row per n-gram."""
        keys = keys.tolist()
        miss = [k for k in keys if k not in self.rows]
        if len(self.rows) + len(miss) > self.most:
            if len(keys) > self.most:  # too many for the store: made for this call only
                return np.stack([self.bind(k) for k in keys])
            self.rows.clear()
            miss = keys
        for k in miss:
            self.rows[k] = len(self.rows)
            self.grid[self.rows[k]] = self.bind(k)
        return self.grid[[self.rows[k] for k in keys]]

    def bind(self, key: int) -> np.ndarray:
        out = np.ones(self.size, np.int8)
        for place in range(self.n):
            out = out * np.roll(self.letter(key >> 21 * place & 0x1FFFFF), place)
        return out

    def bundle(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The text's vector, added up in steps so that few rows are held."""
        out = np.zeros(self.size, np.float64)
        for i in range(0, len(keys), 4096):
            out += counts[i: i + 4096].astype(np.float32) @ self.vectors(keys[i: i + 4096]).astype(np.float32)
        return out


def space(size: int, n: int) -> Space:
    return worker_cache(f"hd:{size}:{n}", lambda: Space(size, n))


def train(docs: DataFrame, size: int = 1024, n: int = 3, languages: int = 1000) -> dict[str, np.ndarray]:
    """Prototype per label of the rows with ``text`` and a non-null ``lang``."""
    ship(docs.sparkSession)

    def sums(batches):
        hd, totals = space(size, n), {}
        for whole in batches:
            for b in slices(whole, 512):
                for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                    keys, counts = hd.grams(text)
                    mine = totals.setdefault(lang, {})
                    for k, c in zip(keys.tolist(), counts.tolist()):
                        mine[k] = mine.get(k, 0) + c
                    if len(mine) > 20_000:  # bundled as they come
                        yield part(hd, lang, totals.pop(lang))
        for lang, mine in totals.items():
            yield part(hd, lang, mine)

    def part(hd: Space, lang: str, mine: dict) -> pa.RecordBatch:
        v = hd.bundle(np.fromiter(mine.keys(), np.int64, len(mine)), np.fromiter(mine.values(), np.int64, len(mine)))
        return batch(lang=([lang] * size, pa.string()), at=(np.arange(size), pa.int32()), v=(v.astype(np.int64), pa.int64()))

    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", F.col("lang").cast("string").alias("lang"))
    if known.select("lang").distinct().count() > languages:  # reads the label column only
        raise ValueError(f"more than {languages} languages")
    rows = known.mapInArrow(sums, "lang string, at int, v long").groupBy("lang", "at").agg(F.sum("v").alias("v"))
    out: dict[str, np.ndarray] = {}
    for r in rows.collect():
        out.setdefault(r["lang"], np.zeros(size))[r["at"]] = r["v"]
    return dict(sorted(out.items()))


def judge_of(prototypes: dict[str, np.ndarray], size: int, n: int):
    """A function from texts to their languages and scores."""
    names = list(prototypes)
    unit = np.stack([p / (np.linalg.norm(p) or 1) for p in prototypes.values()]) if names else np.zeros((0, size))

    def judge(texts):
        hd, langs, scores = space(size, n), [], []
        for text in texts:
            keys, counts = hd.grams(text)
            if not len(keys) or not names:
                langs.append(UND)
                scores.append(0.0)
                continue
            v = hd.bundle(keys, counts)
            cos = np.round(unit @ (v / (np.linalg.norm(v) or 1)), 9)
            k = int(np.argmax(cos))
            langs.append(names[k])
            scores.append(float(min(max(cos[k], 0), 1)))
        return langs, scores

    return judge


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], size: int = 1024, n: int = 3) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row, from its text alone."""
    judge = judge_of(prototypes, size, n)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        langs, scores = judge(b.column("text").to_pylist())
        return batch(doc_id=b.column("doc_id"), lang_pred=(langs, pa.string()), score=(scores, pa.float64()))

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, lang_pred string, score double")


def reject(docs: DataFrame, prototypes: dict[str, np.ndarray], min_score: float, size: int = 1024, n: int = 3) -> DataFrame:
    """The rows, unchanged, whose text has a language with at least ``min_score``."""
    judge = judge_of(prototypes, size, n)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        langs, scores = judge(b.column("text").to_pylist())
        return b.filter(pa.array([g != UND and s >= min_score for g, s in zip(langs, scores)], pa.bool_()))

    return map_arrow(docs, run, docs.schema)


def fold(column: str, folds: int):
    """crc32 of the id as text, modulo ``folds`` (null ids are in fold 0)."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds, F.lit(0))


def held_out_predictions(docs: DataFrame, size: int = 1024, n: int = 3, folds: int = 4, held: int = 2) -> DataFrame:
    """Learn from all folds but one and predict every document."""
    prototypes = train(docs.filter(fold("doc_id", folds) != held), size, n)
    out = predict(docs, prototypes, size, n)
    return out.select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), "lang_pred", "score")
