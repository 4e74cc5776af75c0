"""Token ids in length-delimited binary records with a separate offset index.

A data file is a sequence of records: 8-byte length of the payload, masked CRC-32 of those 8 bytes, the payload, masked CRC-32 of
the payload (all little-endian).  A payload is a document id (8 bytes), one byte telling whether it is null, one byte with the
id width (2 or 4), and the ids.  The index beside it holds three 8-byte numbers per record (offset, ids before it in the file, ids),
so that readers can fetch records in any order without scanning.

Documents are dealt out by ranges of their id and sorted inside a range, so the files in order of their range hold all documents in
ascending order (null ids first, equal ids by text).  A task writes files under names of its own attempt and returns
one manifest row each; only files named in the manifest count, so repeated or speculative tasks do no harm.  The driver sees the
manifest: one row for each partition.

Edge cases: a null text is empty and yields the end id alone; repeated rows are separate records; an empty table has no files;
other columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import byte_alphabet
from .common import LOWER, batch, new_file, open_fs, shared_dir, ship, slices, worker_cache

HEAD = struct.Struct("<QI")
CRC = struct.Struct("<I")
BODY = struct.Struct("<qBB")
MASK_DELTA = 0xA282EAD8  # fixed value of the masking rule
MANIFEST = "part int, data string, index string, records long, tokens long"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    n = struct.pack("<Q", len(payload))
    return n + CRC.pack(masked(n)) + payload + CRC.pack(masked(payload))


def unframe(read) -> bytes | None:
    """The next payload from ``read(n)``, or None at the end; raises where a checksum fails."""
    head = read(HEAD.size)
    if not head:
        return None
    n, crc = HEAD.unpack(head)
    if masked(head[:8]) != crc:
        raise ValueError("record length fails its checksum")
    payload = read(n)
    if CRC.unpack(read(CRC.size))[0] != masked(payload):
        raise ValueError("record fails its checksum")
    return payload


def pack(doc: int | None, ids: np.ndarray) -> bytes:
    width = 2 if len(ids) == 0 or ids.max() < 65536 else 4
    return BODY.pack(doc or 0, doc is None, width) + ids.astype(f"<u{width}").tobytes()


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc, null, width = BODY.unpack_from(payload)
    return None if null else doc, np.frombuffer(payload, f"<u{width}", offset=BODY.size).astype(np.uint32)


SEPARATORS = re.compile("[\x1c-\x1f]")
#: Parts whose lower case and composition are the same one character at a time, in every version of Unicode at hand.
PLAIN = re.compile("[!-~\u00a1-\u012f\u0131-\u024f]+")
# fixed value: the pattern by which the tokenizer file cuts text into words
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
WORD_END = "</w>"
#: The last byte of a word of letters, written as a byte that such words do not hold elsewhere: a-z as A-Z, 80-BF as 00-3F (hex).
LAST = {b: b - 32 for b in range(97, 123)} | {b: b - 128 for b in range(128, 192)}
LAST_BYTE = {b: bytes([m]) for b, m in LAST.items()}


def letter_ranks(path: str) -> dict[bytes, int] | None:
    """Ids of the file's tokens of letters, last bytes of words rewritten; None if its ids are not in the order of its merges."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    ids = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if model["end_of_word_suffix"] != WORD_END or ids != list(range(512, 512 + len(ids))):
        return None
    back, inner = byte_alphabet(), {*range(97, 123), *range(128, 256)}
    ranks = {}
    for token, i in vocab.items():
        end = token.endswith(WORD_END)
        raw = [back[c] for c in token.removesuffix(WORD_END)]
        if inner.issuperset(raw) and (not end or raw[-1] in LAST):
            ranks[bytes([*raw[:-1], LAST[raw[-1]]] if end else raw)] = i
    return ranks


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordEncoder(dict):
    """Ids of a tokenizer that drops white space, packed as little-endian 32-bit numbers.  White space separates its words and joins
    none, so that a text's ids are those of its blank-separated parts in order; each distinct part is encoded once and then
    remembered here (up to a bound).  Words of Latin letters go through a rank encoder built from the file's own merges,
    everything else through the library."""

    def __init__(self, path: str, most: int = 800_000, long_part: int = 1000):
        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        ranks = letter_ranks(path)
        self.ranked = tiktoken.Encoding("letters", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={}) if ranks else None
        self.marks: dict[str, list[int]] = {}
        self.most, self.long_part = most, long_part

    def _whole(self, text: str) -> list[int]:
        return self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _ranked(self, part: str) -> list[int]:
        """Ids of a plain part, word by word."""
        ids: list[int] = []
        part = part.lower()
        for w in (part,) if part.isalpha() else WORDS.findall(part):
            if w[0].isalpha():
                raw = w.encode()
                ids += self.ranked._encode_single_piece(raw[:-1] + LAST_BYTE[raw[-1]])
            else:  # a contraction, a digit or a run of marks is a word by itself too
                got = self.marks.get(w)
                if got is None:
                    got = self.marks[w] = self._whole(w)
                ids += got
        return ids

    def __missing__(self, part: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
            self.marks.clear()
        plain = self.ranked and len(part) <= self.long_part and "<|" not in part and PLAIN.fullmatch(part)
        ids = self[part] = packed(self._ranked(part) if plain else self._whole(part))
        return ids

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def encode_packed(self, text: str) -> bytes:
        if SEPARATORS.search(text):  # white space to str.split(), not to the library
            return packed(self._whole(text))
        if "<|" not in text:  # a special token's name is told by case; all other text is lower-cased by the file's own rules
            text = text.lower() if text.isascii() else text.encode().translate(LOWER).decode()
        return b"".join(map(self.__getitem__, text.split()))


def write_records(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 2, files: int | None = None):
    """Encode and write; returns the manifest rows in file order."""
    spark = docs.sparkSession
    ship(spark)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = d.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches):
        enc = worker_cache(f"words:{tokenizer_path}", lambda: WordEncoder(tokenizer_path))
        end = packed([end_id])
        out, index, at, tokens = None, [], 0, 0
        for whole in batches:
            for b in slices(whole, 256):
                if out is None:
                    fs, _ = open_fs(folder)
                    data_uri, data_path = new_file(folder, "ids")
                    out = fs.open_output_stream(data_path)
                for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                    ids = np.frombuffer(enc.encode_packed(text) + end, "<u4")
                    record = frame(pack(doc, ids))
                    index.append((at, tokens, len(ids)))
                    out.write(record)
                    at += len(record)
                    tokens += len(ids)
        if out is not None:
            out.close()
            with fs.open_output_stream(data_path + ".index") as f:
                f.write(np.array(index, "<i8").tobytes())
            yield batch(part=([TaskContext.get().partitionId()], pa.int32()), data=([data_uri], pa.string()), index=([data_uri + ".index"], pa.string()),
                        records=([len(index)], pa.int64()), tokens=([tokens], pa.int64()))

    return sorted(dealt.mapInArrow(write, MANIFEST).collect(), key=lambda r: r["part"])


def read_record(data: str, index: str, k: int) -> tuple[int | None, np.ndarray]:
    """Record ``k`` of a file, through the index: one seek."""
    fs, path = open_fs(index)
    with fs.open_input_file(path) as f:
        f.seek(24 * k)
        at = np.frombuffer(f.read(24), "<i8")[0]
    fs, path = open_fs(data)
    with fs.open_input_file(path) as f:
        f.seek(int(at))
        return unpack(unframe(f.read))


def read_records(spark: SparkSession, manifest) -> DataFrame:
    """``doc_id, start, ids`` of every record of the files, ``start`` counting all ids of the files before."""
    ship(spark)
    rows, before = [], 0
    for r in manifest:
        rows.append((r["data"], r["index"], before))
        before += r["tokens"]
    files = spark.createDataFrame(rows, "data string, index string, before long")
    files = files.repartition(max(1, len(rows)))

    def read(batches):
        for b in batches:
            for row in b.to_pylist():
                fs, path = open_fs(row["index"])
                with fs.open_input_stream(path) as f:
                    index = np.frombuffer(f.read(), "<i8").reshape(-1, 3)
                fs, path = open_fs(row["data"])
                with fs.open_input_stream(path, buffer_size=1 << 20) as f:
                    for i in range(0, len(index), 256):
                        part, docs, ids = index[i: i + 256], [], []
                        for _ in range(len(part)):
                            doc, one = unpack(unframe(f.read))
                            docs.append(doc)
                            ids.append(one)
                        if [len(x) for x in ids] != part[:, 2].tolist():
                            raise ValueError("index and records differ")
                        yield batch(doc_id=(docs, pa.int64()), start=(part[:, 1] + row["before"], pa.int64()), ids=([x.tobytes() for x in ids], pa.binary()))

    return files.mapInArrow(read, "doc_id long, start long, ids binary")


def token_records(docs: DataFrame, tokenizer_path: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Write all documents and read them back: ``doc_id, start, ids`` (little-endian unsigned 32-bit)."""
    spark = docs.sparkSession
    return read_records(spark, write_records(docs, tokenizer_path, folder or shared_dir(spark, "ids"), end_id))


def digests(records: DataFrame) -> DataFrame:
    n = (F.octet_length("ids") / 4).cast("long")
    return records.select("doc_id", "start", n.alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
