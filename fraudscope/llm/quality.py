"""Quality rules on repetition coverage: how much of a text lies inside duplicated n-grams and lines.

Words become integers, n-grams become rolling 64-bit hashes (one multiplication per added word gives the next length), and
windows with equal hashes are compared word by word before they count as equal.  Only windows whose two shorter windows were found
again can occur again, so each length hashes what the one before left.  All of it is one pass over each text without a
shuffle; memory is bounded by one text.

Edge cases: a null text has no words and fails the base rules; empty texts likewise; repeated rows give repeated rows; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, map_arrow

#: Largest share of a text's characters in its most frequent n-gram (2-4), in n-grams that stood before (5-10) and in lines that stood
#: before.  The limits of 5-10 are 0.05 above the published ones for web text: those reject texts of a hundred words for one header line
#: that occurs twice, which the base rule (30 % of the words, first occurrence included) lets pass.
TOP_LIMITS = {2: 0.20, 3: 0.18, 4: 0.16}
DUP_LIMITS = {5: 0.20, 6: 0.19, 7: 0.18, 8: 0.17, 9: 0.16, 10: 0.15}
LINE_CHAR_LIMIT = 0.20
MIN_WORDS, BASE_WINDOW, BASE_PERCENT = 20, 8, 30
SPACE, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
BLANK = SPACE.decode()
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _spread(ids: np.ndarray) -> np.ndarray:
    """Distinct 64-bit values of small integers (a bijective mix)."""
    x = ids.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _equal_windows(hashes: np.ndarray, ids: np.ndarray, n: int, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window of each class, class of each window, and class sizes; hash matches are verified on the words.  ``at`` are the
    windows' places (all in order if not given)."""
    at = np.arange(len(hashes)) if at is None else at
    _, first, cls, size = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    again = np.flatnonzero(size[cls] > 1)
    if len(again):
        here, lead = at[again], at[first[cls[again]]]
        if any((ids[here + j] != ids[lead + j]).any() for j in range(n)):  # a collision: compare whole windows instead
            rows = np.lib.stride_tricks.sliding_window_view(ids, n)[at]
            _, first, cls, size = np.unique(rows, axis=0, return_index=True, return_inverse=True, return_counts=True)
            cls = cls.ravel()
    return first, cls, size


def _covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Words inside any of the windows [start, start + n)."""
    step = np.bincount(starts, minlength=total + 1) - np.bincount(starts + n, minlength=total + 1)
    return np.cumsum(step[:-1]) > 0


def measure(text: str | None) -> dict:
    """All measures of one text."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    out = {
        "n_words": n, "word_chars": len(text) - (len(raw) - len(raw.translate(None, SPACE))),
        "n_symbols": len(raw) - len(raw.translate(None, SYMBOLS)), "n_dup_lines": 0, "n_repeat_words": 0,
        "dup_line_char_share": 0.0, "top": {k: 0.0 for k in TOP_LIMITS}, "dup": {k: 0.0 for k in DUP_LIMITS},
    }
    if not n:
        return out
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    distinct = set(lines)
    if len(distinct) < len(lines):
        chars = sum(map(len, lines))
        out["n_dup_lines"] = len(lines) - len(distinct)
        out["dup_line_char_share"] = (chars - sum(map(len, distinct))) / chars
    known = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(known.__getitem__, words), np.int64, n)
    again = np.bincount(ids)[ids] > 1
    lengths = ends = None
    rolling = value = _spread(ids)
    for k in range(2, min(n, max(DUP_LIMITS)) + 1):
        # a window occurs again only if both windows one word shorter inside it do
        at = np.flatnonzero(again[:-1] & again[1:])
        if not len(at):
            break
        with np.errstate(over="ignore"):
            rolling = rolling[: n - k + 1] * MULTIPLIER + value[k - 1:]
        first, cls, size = _equal_windows(rolling[at], ids, k, at)
        places = at[size[cls] > 1]
        again = np.zeros(n - k + 1, bool)
        again[places] = True
        if not len(places):
            break
        if lengths is None:
            lengths = np.fromiter(map(len, b"\n".join(known).decode("utf-8").split("\n")), np.int64, len(known))[ids]
            ends = np.concatenate([[0], np.cumsum(lengths)])
        lead = at[first]
        if k in TOP_LIMITS:
            best = size == size.max()
            chars = ends[lead[best] + k] - ends[lead[best]]
            out["top"][k] = float((chars * size[best]).max() / out["word_chars"])
        if k in DUP_LIMITS:
            out["dup"][k] = float(lengths[_covered(at[lead[cls] != at], k, n)].sum() / out["word_chars"])
        if k == BASE_WINDOW:
            out["n_repeat_words"] = int(_covered(places, k, n).sum())
    return out


def verdict(m: dict) -> tuple[bool, bool]:
    """(base_failed, kept)."""
    failed = m["n_words"] < MIN_WORDS or 100 * m["n_repeat_words"] > BASE_PERCENT * m["n_words"]
    bad = (
        m["dup_line_char_share"] > LINE_CHAR_LIMIT
        or any(m["top"][k] > v for k, v in TOP_LIMITS.items()) or any(m["dup"][k] > v for k, v in DUP_LIMITS.items())
    )
    return failed, not (failed or bad)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SHARES = [*(f"top_{k}" for k in TOP_LIMITS), *(f"dup_{k}" for k in DUP_LIMITS)]
OUT = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, dup_line_char_share double, " + ", ".join(f"{c}_share double" for c in SHARES)


def repetition_quality(docs: DataFrame) -> DataFrame:
    """One row per document: the counts, both verdicts and every measured share."""

    def score(b: pa.RecordBatch) -> pa.RecordBatch:
        ms = [measure(t) for t in b.column("text").to_pylist()]
        vs = [verdict(m) for m in ms]
        cols = {c: ([m[c] for m in ms], pa.int64()) for c in COUNTS}
        cols |= {"base_failed": ([v[0] for v in vs], pa.bool_()), "kept": ([v[1] for v in vs], pa.bool_())}
        cols |= {c: ([m[c] for m in ms], pa.float64()) for c in ("dup_line_char_share",)}
        cols |= {f"top_{k}_share": ([m["top"][k] for m in ms], pa.float64()) for k in TOP_LIMITS}
        cols |= {f"dup_{k}_share": ([m["dup"][k] for m in ms], pa.float64()) for k in DUP_LIMITS}
        return batch(doc_id=b.column("doc_id"), **cols)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), score, OUT)
