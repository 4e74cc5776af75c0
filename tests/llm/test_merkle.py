"""The Merkle manifest against a plain recursion over lists."""

import hashlib
import zlib

import pytest

from fraudscope.llm import merkle

NAMES = "doc_id long, source string, lang string, n_chars long, text string, grp string, rank long, n int, h string, block long, tree string, path string, item string, key string"
PAD = ("g", 1, 2, "h", 3, "t", "p", "i", "k")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes, fan):
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(paths):
            low = at[i] // fan * fan
            p.append(("".join(nodes[low: at[i]]), "".join(nodes[at[i] + 1: low + fan])))
            at[i] //= fan
        nodes = [H(*nodes[i: i + fan]) for i in range(0, len(nodes), fan)]
    return nodes[0], paths


def brute(rows, fan=3):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    inner = {s: tree([leaf(r) for r in groups[s]], fan) for s in order}
    if not order:
        return []
    root, outer = tree([inner[s][0] for s in order], fan)
    out = []
    for s, above in zip(order, outer):
        for r, below in zip(groups[s], inner[s][1]):
            path, now = below + above, r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                now = (*r[:4], r[4].replace("\n", ""))
            h = leaf(now)
            for left, right in path:
                h = H(left, h, right)
            out.append((r[0], leaf(r), inner[s][0], root, H("".join(a + b for a, b in path)), h, h == root))
    return sorted(out, key=str)


ROWS = [
    *((i, "hot", "en", 5 * i, f"text {i}\nline" if i % 3 else f"text {i}") for i in range(100)), (None, "hot", None, None, None), (None, "hot", "en", 1, "a\nb"),
    (5, "hot", "de", 2, "same id\nother text"), (7, "hot", "en", 35, "text 7\nline"), (1, None, "en", 3, ""), (2, None, None, 3, "x" * 70_000 + "\n"),
    *((i, f"s{i % 11}", "fr", None, "é\nü") for i in range(200, 225)), (900, "", "en", 1, "empty source"), (901, "Ünï", "en", 1, "\n"), (902, "lone", "en", 1, "\n\n"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, *PAD) for r in rows], NAMES)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("rows", [ROWS, ROWS[:1], ROWS[:4], ROWS[100:103], []], ids=["all", "one", "four", "null ids", "none"])
def test_manifest_equals_recursion(spark, rows):
    assert found(merkle.proven(frame(spark, rows))) == brute(rows)


@pytest.mark.parametrize("fan,levels", [(3, 1), (3, 2), (2, 2), (5, 1)])
def test_several_stages_of_blocks(spark, fan, levels):
    out = merkle.manifest(frame(spark, ROWS), "source", "doc_id", fan=fan, levels=levels)
    got = [(r["doc_id"], r["leaf"], r["subroot"], r["root"], H("".join(s["left"] + s["right"] for s in r["path"]))) for r in out.collect()]
    assert sorted(got, key=str) == [r[:5] for r in brute(ROWS, fan)]


def test_any_column_can_be_covered_and_carried(spark):
    from pyspark.sql import functions as F

    out = merkle.manifest(frame(spark, ROWS), "lang", "n_chars", columns=("text",), extra={"who": F.col("doc_id")}).collect()
    assert len(out) == len(ROWS) and {r["who"] for r in out} == {r[0] for r in ROWS}
    assert {r["leaf"] for r in out} == {H("-" if r[4] is None else f"{len(r[4].encode())}:{r[4]}") for r in ROWS}
