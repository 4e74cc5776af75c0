"""BPE encoding and decoding by tree concatenation.

A long text is cut into equal leaves without looking at its content, the leaves
are encoded in parallel by different tasks, and neighbours are then joined
pairwise up a tree.  At each join a window around the seam is encoded again.  The
window starts and ends at places where the pre-tokenizer always cuts, whatever
stands further away; the left node's ids must end with the encoding of the
window's left half and the right node's ids must begin with that of its right
half.  If no such place is in reach or a side disagrees, the window doubles; in
the end it is the whole text, so the result always equals encoding in one go.

Edge cases: a null text counts as empty (no ids, decoded ''); a special token's
string inside a text is that token, as in the tokenizers library; repeated rows
give repeated rows; null ids are kept; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import batch, map_arrow, ship, worker_cache

# fixed values: the pattern by which byte-level BPE of this family splits text before merging
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Places where the pattern above always cuts, judged from the two characters around them (and no more).
SEAM = regex.compile(
    r"(?<=\p{L})(?=[^\p{L}\s])|(?<=\p{N})(?=[^\p{N}\s])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])|(?<=\S)(?=\s)"
)


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in of each byte in byte-level vocabularies, back to the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """Encoder of one tokenizer file.  Short texts go through the rank encoder, long ones through the file's own library;
    both give the same ids, since the ids of the file's tokens are in merge order (checked on loading)."""

    def __init__(self, path: str, long_chars: int = 65536):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.long_chars = long_chars
        back = byte_alphabet()
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.ranked = all(vocab[a + b] == 256 + i for i, (a, b) in enumerate(pairs))
        ranks = {bytes(back[c] for c in t): i for t, i in vocab.items() if t not in self.special}
        self.fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=self.special)

    def encode(self, text: str) -> list[int]:
        if self.ranked and len(text) <= self.long_chars:
            return self.fast.encode(text, allowed_special="all", disallowed_special=())
        return self.library.encode(text, add_special_tokens=False).ids

    def decode(self, ids: list[int]) -> str:
        return self.fast.decode_bytes(ids).decode("utf-8", "replace")

    # -- tree concatenation ------------------------------------------------
    def _inside_special(self, text: str, p: int) -> bool:
        for s in self.special:
            lo = max(0, p - len(s) + 1)
            at = text.find(s, lo, p + len(s) - 1)
            if at != -1 and at < p:
                return True
        return False

    def _seams(self, text: str, lo: int, hi: int) -> list[int]:
        """Certain cuts p with lo <= p <= hi; both neighbours of each lie inside ``text``."""
        return [m.start() for m in SEAM.finditer(text, max(lo, 1), max(lo, 1, min(hi, len(text) - 1))) if not self._inside_special(text, m.start())]

    def join(self, left: tuple[str, np.ndarray], right: tuple[str, np.ndarray], window: int = 64) -> tuple[str, np.ndarray]:
        """Ids of left+right from the ids of both sides."""
        (a, ids_a), (b, ids_b) = left, right
        reach = max(map(len, self.special), default=0) + 2
        while True:
            # one more character than the window on either side, so that both neighbours of a cut are seen
            lo, hi = max(0, len(a) - window - reach), min(len(b), window + reach)
            text = a[lo:] + b[:hi]
            seam = len(a) - lo
            cuts_a = self._seams(text, reach if lo else 1, seam - reach)
            cuts_b = self._seams(text, seam + reach, len(text) - reach) if hi < len(b) else []
            i = lo + cuts_a[0] if cuts_a else (0 if lo == 0 else None)
            j = cuts_b[-1] - seam if cuts_b else (len(b) if hi == len(b) else None)
            if i is not None and j is not None:
                tail = np.asarray(self.encode(a[i:]), np.int32) if i else ids_a
                head = np.asarray(self.encode(b[:j]), np.int32) if j < len(b) else ids_b
                agree = len(tail) <= len(ids_a) and np.array_equal(ids_a[len(ids_a) - len(tail):], tail)
                agree = agree and len(head) <= len(ids_b) and np.array_equal(ids_b[: len(head)], head)
                if agree:
                    mid = np.asarray(self.encode(a[i:] + b[:j]), np.int32)
                    return a + b, np.concatenate([ids_a[: len(ids_a) - len(tail)], mid, ids_b[len(head):]])
            window *= 2

    def concat(self, nodes: list[tuple[str, np.ndarray]], window: int = 64) -> tuple[str, np.ndarray]:
        """Join neighbours pairwise, level by level, until one node is left."""
        while len(nodes) > 1:
            joined = [self.join(nodes[k], nodes[k + 1], window) for k in range(0, len(nodes) - 1, 2)]
            nodes = joined + ([nodes[-1]] if len(nodes) % 2 else [])
        return nodes[0]


def bpe(path: str) -> ByteBPE:
    return worker_cache(f"bpe:{path}", lambda: ByteBPE(path))


OUT = "doc_id long, ids array<int>, decoded string"


def encode_decode(docs: DataFrame, tokenizer_path: str, leaf_chars: int = 16384, window: int = 64) -> DataFrame:
    """``doc_id, ids, decoded`` of every text.

    Texts of at most ``leaf_chars`` characters are encoded where they are read: no shuffle.  Longer ones are cut into leaves
    that are dealt out by (text, leaf), encoded there, and joined per text.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    short, long = d.filter(F.length("text") <= leaf_chars), d.filter(F.length("text") > leaf_chars)
    ship(d.sparkSession)

    def whole(b: pa.RecordBatch) -> pa.RecordBatch:
        enc = bpe(tokenizer_path)
        ids = [enc.encode(t) for t in b.column("text").to_pylist()]
        return batch(doc_id=b.column("doc_id"), ids=(ids, pa.list_(pa.int32())), decoded=([enc.decode(i) for i in ids], pa.string()))

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            key = hashlib.blake2b(t.encode(), digest_size=16).digest()
            rows += [(doc, key, k, t[i: i + leaf_chars]) for k, i in enumerate(range(0, len(t), leaf_chars))]
        c = list(zip(*rows))
        return batch(doc_id=(c[0], pa.int64()), key=(c[1], pa.binary()), leaf=(c[2], pa.int32()), piece=(c[3], pa.string()))

    def leaves(b: pa.RecordBatch) -> pa.RecordBatch:
        enc = bpe(tokenizer_path)
        ids = [np.asarray(enc.encode(t), np.int32).tobytes() for t in b.column("piece").to_pylist()]
        return batch(**{n: b.column(n) for n in ("doc_id", "key", "leaf", "piece")}, ids=(ids, pa.binary()))

    def tree(t: pa.Table) -> pa.Table:
        enc = bpe(tokenizer_path)
        rows = {}
        order = t.column("leaf").to_pylist()
        for k, piece, ids in zip(order, t.column("piece").to_pylist(), t.column("ids").to_pylist()):
            rows[k] = (piece, np.frombuffer(ids, np.int32))
        copies = order.count(0)  # repeated rows share a group
        _, ids = enc.concat([rows[k] for k in sorted(rows)], window)
        ids = ids.tolist()
        doc = t.column("doc_id")[0].as_py()
        return pa.Table.from_batches([batch(doc_id=([doc] * copies, pa.int64()), ids=([ids] * copies, pa.list_(pa.int32())), decoded=([enc.decode(ids)] * copies, pa.string()))])

    pieces = map_arrow(long, cut, "doc_id long, key binary, leaf int, piece string", rows=16)
    dealt = map_arrow(pieces.repartition("key", "leaf"), leaves, "doc_id long, key binary, leaf int, piece string, ids binary", rows=64)
    return map_arrow(short, whole, OUT, rows=256).unionByName(dealt.groupBy("doc_id", "key").applyInArrow(tree, OUT))


def digests(encoded: DataFrame, with_ids: bool = False) -> DataFrame:
    """Count and digests of what ``encode_decode`` returns, and the ids themselves if asked for."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), *(["ids"] if with_ids else []),
    )
