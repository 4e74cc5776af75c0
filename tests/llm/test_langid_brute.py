"""Language ID against the same arithmetic written out over single n-grams, and its ties."""

import math
import zlib

import numpy as np
import pytest

from fraudscope.llm import langid

NAMES = "doc_id long, text string, lang string, source string"
SIZE, N, SEED = 128, 3, 7
TEXTS = [
    ("en", "The quick brown fox jumps over the lazy dog."), ("en", "She sells sea shells by the shore, 12 of them"), ("de", "Der schnelle Fuchs springt über den faulen Hund."),
    ("de", "Größe und Straße, weiß man's?"), ("fr", "Le renard brun saute par-dessus le chien paresseux."), ("fr", "Où est la bibliothèque ?"), (None, "the unlabelled text of the dog"),
    ("en", None), ("fr", ""), ("de", "123 456 !!"), ("en", "a"), ("fr", "É"), ("xx", "the the the"), ("en", "word " * 3000),
]


def bits(c):
    return [2 * int(b) - 1 for b in np.random.default_rng([SEED, c]).integers(0, 2, SIZE)]


def vector(text):
    """Sum over the n-grams of the products of their letters' vectors, the j-th letter from the end rotated j places."""
    letters = [c if c.isalpha() else " " for c in (text or "").lower()]
    if not any(c != " " for c in letters):
        return None
    line = " " + "".join(letters) + " "
    while "  " in line:
        line = line.replace("  ", " ")
    line = line.ljust(N)
    out, known = [0] * SIZE, {}
    for i in range(len(line) - N + 1):
        gram = line[i: i + N]
        if gram not in known:
            rows = [bits(ord(c)) for c in reversed(gram)]
            known[gram] = [math.prod(row[(k - j) % SIZE] for j, row in enumerate(rows)) for k in range(SIZE)]
        out = [a + b for a, b in zip(out, known[gram])]
    return out


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))


def brute(rows, held=2):
    learned = {}
    for i, text, lang in rows:
        v = vector(text) if lang is not None and (0 if i is None else zlib.crc32(str(i).encode()) % 4) != held else None
        if v:
            learned[lang] = [a + b for a, b in zip(learned.get(lang, [0] * SIZE), v)]
    out = []
    for i, text, _ in rows:
        v, best = vector(text), ("und", 0.0)
        if v and learned:
            scores = {g: cosine(v, p) for g, p in sorted(learned.items())}
            top = max(scores.values())
            best = (next(g for g in scores if scores[g] >= top - 1e-9), max(top, 0.0))
        out.append((i, i is not None and zlib.crc32(str(i).encode()) % 4 == held, *best))
    return out


def test_predictions_and_scores_equal_brute_force(spark):
    rows = [(k * 20 + j if k * 20 + j != 33 else None, t, g) for k in range(3) for j, (g, t) in enumerate(TEXTS)]
    df = spark.createDataFrame([(i, t, g, "s") for i, t, g in rows], NAMES).repartition(3)
    got = sorted((tuple(r) for r in langid.held_out_predictions(df, size=SIZE).collect()), key=str)
    want = sorted(brute(rows), key=str)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=1e-6)


def test_equal_prototypes_go_to_the_first_language(spark):
    rows = [(1, "same text here", "zz"), (3, "same text here", "aa"), (4, "same text here", "mm"), (5, "text here", None)]
    df = spark.createDataFrame([(i, t, g, "s") for i, t, g in rows], NAMES)
    assert {r["lang_pred"] for r in langid.predict(df, langid.train(df, size=SIZE), size=SIZE).collect()} == {"aa"}
