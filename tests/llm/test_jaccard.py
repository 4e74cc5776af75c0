"""The Jaccard join against brute force: whole query, regions, parts."""

import random
import re
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fraudscope.llm import jaccard

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
NAMES = "doc_id long, text string, rid long, point string, cell string, root long, n int"


def copies(seed, n, length, edits):
    """``n`` texts at different distances from one another: each changes up to ``edits`` words of one of the texts before."""
    rng = random.Random(seed)
    out = [[f"w{rng.randrange(5000)}" for _ in range(length)]]
    for _ in range(n - 1):
        words = list(rng.choice(out))
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(length)] = f"x{rng.randrange(10**6)}"
        out.append(words)
    return [" ".join(w) for w in out]


TEXTS = [
    None, "", " \n\t", "One", "one", "One two", "one TWO", "one two three", "Ünï \x85 x", *copies(1, 60, 90, 6), *copies(2, 25, 40, 3), *copies(3, 12, 300, 8),
    *(" ".join(f"{p}{i}" for i in range(2000)) for p in "ab"), "a b c " * 50, "a b c " * 70,
]


def brute(rows, percent=90):
    def shingles(text):
        w = WORDS.findall((text or "").translate(LOW))
        return frozenset([tuple(w)] if 0 < len(w) < 3 else zip(w, w[1:], w[2:]))

    sets = [(i, shingles(t)) for i, t in rows]
    top = list(range(len(sets)))
    changed = True
    linked = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a][1] and sets[b][1] and 100 * len(sets[a][1] & sets[b][1]) >= percent * len(sets[a][1] | sets[b][1])]
    while changed:
        changed = False
        for a, b in linked:
            low = min(top[a], top[b])
            changed |= top[a] != low or top[b] != low
            top[a] = top[b] = low
    named = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            named[top[k]] = min(i, named.get(top[k], i))
    return sorted(((i, len(s), named.get(top[k]) if s else i) for k, (i, s) in enumerate(sets)), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "p", "c", 2, 3) for i, t in rows], NAMES)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    numbered = list(enumerate(TEXTS))
    return [*numbered, numbered[12], numbered[2], (7, TEXTS[40]), (None, TEXTS[20]), (None, "nobody else has this text")]


def test_join_equals_brute_force(spark, rows):
    assert found(jaccard.similar(frame(spark, rows))) == brute(rows)


def test_large_regions_are_cut_into_cells_and_blocks(spark, rows):
    """Regions far over their size: several rounds of pivots, cells that will not shrink go into blocks."""
    assert found(jaccard.similar(frame(spark, rows), region=700)) == brute(rows)


def test_other_threshold(spark, rows):
    assert found(jaccard.similar(frame(spark, rows), percent=80, part=3)) == brute(rows, 80)


def test_empty_table(spark, rows):
    out = jaccard.similar(frame(spark, rows[:1]).filter("false"))
    assert out.columns == ["doc_id", "n_shingles", "component_id"] and out.count() == 0


def test_parts_too_large_for_the_threshold():
    with pytest.raises(ValueError):
        jaccard.shared(90, 9)


def test_shared_share():
    assert jaccard.shared(90, 8) == Fraction(1, 10) and jaccard.shared(90, 7) == Fraction(1, 5)


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**9), st.integers(1, 400), st.sampled_from([(90, 7), (90, 8), (80, 3), (95, 12)]))
def test_similar_sets_share_a_part(seed, size, rule):
    """Also where hashes fill the space unevenly."""
    percent, part = rule
    rng = np.random.default_rng(seed)
    x = np.unique(rng.integers(0, 2**64, size, np.uint64) >> np.uint64(rng.integers(0, 40)))
    spare = int(len(x) * (100 - percent) / 100)
    gone = int(rng.integers(0, spare + 1))
    more = rng.integers(0, 2**64, max(0, int(rng.integers(0, spare - gone + 1))), np.uint64) >> np.uint64(rng.integers(0, 40))
    y = np.union1d(rng.permutation(x)[gone:], more)
    both = len(np.intersect1d(x, y))
    share = jaccard.shared(percent, part)
    if 100 * both >= percent * len(np.union1d(x, y)):
        assert len(np.intersect1d(jaccard.parts(x, part, share), jaccard.parts(y, part, share)))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9), st.integers(2, 120), st.integers(0, 12))
def test_region_equals_all_pairs(seed, n, edits):
    sets = [jaccard.shingles(t) for t in copies(seed, n, 60, edits)]
    flat, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    links = jaccard.Region(flat, starts, 90, pivots=3, few=4).join()

    def groups(pairs):
        top = list(range(n))
        for _ in range(n):
            for a, b in pairs:
                top[a] = top[b] = min(top[a], top[b])
        return top

    true = {(a, b) for a in range(n) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 90 * len(np.union1d(sets[a], sets[b]))}
    assert all((max(p), min(p)) in true for p in links) and len(links) < n
    assert groups(links) == groups(true)
