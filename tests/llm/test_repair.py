"""Conversation repair against a plain dynamic program over all rows."""

import hashlib
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fraudscope.llm import repair

INK = re.compile(r"[^\x20\x09-\x0D]")
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
NAMES = "conv_id long, turn long, role string, text string, rank long, chunk long, same string, first long, sha string, id long, fault string"


def best(rows):
    """(cost, audit, lines) of the cheapest edits of (turn, role, text, fault)."""
    def written(q, text=""):
        return ("user" if NEXT[q] == 2 else "assistant") + ":" + text

    def inserted(now):
        for _ in range(3):
            for q, (c, a, o) in list(now.items()):
                new = (c + 3, a + "I", [*o, written(q)])
                if NEXT[q] not in now or new[:2] < now[NEXT[q]][:2]:
                    now[NEXT[q]] = new
        return now

    now = inserted({0: (0, "", [])})
    for _, role, text, fault in rows:
        new, more = {}, 3 if fault == "truncated" else 0
        for q, (c, a, o) in now.items():
            ways = [(q, (c + 4, a + "D", o))]
            if fault not in ("blank", "duplicate"):
                ways.append((NEXT[q], (c + 3 + more, a + "R", [*o, written(q, text)])))
                if (q, role[:1]) in KEPT:
                    ways.append((KEPT[q, role[:1]], (c + more, a + "K", [*o, f"{role}:{text}"])))
            for r, w in ways:
                if r not in new or w[:2] < new[r][:2]:
                    new[r] = w
        now = inserted(new)
    return min((now[q] for q in (0, 3) if q in now), key=lambda w: w[:2])


def summary(rows):
    seen, out = set(), []
    for turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        ink = INK.findall(text)
        fault = "blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((turn, role, text, fault))
    turns = [r[0] for r in out if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(out, out[1:]))
    cost, audit, lines = best(out)
    faults = [r[3] for r in out]
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def brute(rows, damage=True):
    def plain(v):
        return " " if v is None else str(v)

    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        kind = zlib.crc32(f"{plain(conv)}:{plain(turn)}".encode()) % 20 if damage else None
        role, text = "user" if kind == 4 else plain(role), "" if kind == 1 else re.sub("[.!?]", "", plain(text)) if kind == 2 else plain(text)
        mine += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return sorted(((c, *summary(r)) for c, r in out.items()), key=str)


ROLES = ["user", "assistant", "system", "tool", "", "User", "umpire", None]
ROWS = [
    *((c, t, ("system", "user", "assistant")[0 if t == 0 else 1 + t % 2], f"Text {c * t % 5} of it{'.!?,'[t % 4]}") for c in range(60) for t in range(c % 9)),
    *((100 + k, t, ROLES[(k * 7 + t * t) % 8], [f"a {t % 3}.", "open", " \t\n", None, "", "done!  \n"][(k + t * 3) % 6]) for k in range(30) for t in range(12)),
    (200, None, "user", "No turn."), (200, None, "assistant", "None here."), (201, None, "user", "Twice."), (201, 3, "assistant", "x."), (201, 9, "assistant", "y."),
    (None, 1, "user", "Who?"), (None, None, "assistant", "Nobody."), (202, 1, "user", "Long. " * 20_000), (203, 5, "user", "Same."), (203, 5, "user", "Same."), (203, 5, "assistant", "Other."),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "s", 3, "x", 4, "f") for r in rows], NAMES)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark):
    assert found(repair.repaired(frame(spark, ROWS))) == brute(ROWS)


@pytest.mark.parametrize("chunk", [1, 2, 5])
def test_long_conversations_in_chunks(spark, chunk):
    rows = frame(spark, ROWS)
    assert found(repair.repair(repair.damaged(rows), rows, chunk=chunk)) == brute(ROWS)


def test_undamaged_rows_and_hot_conversation(spark):
    hot = [(1, t % 700, ROLES[t * t % 11 % 3], f"Row {t % 400}{'. '[t % 2]}") for t in range(1500)]
    assert found(repair.repair(frame(spark, ROWS + hot), chunk=64)) == brute(ROWS + hot, damage=False)


def test_dropped_conversations_and_empty_tables(spark):
    rows = frame(spark, ROWS)
    none = rows.filter("false")
    assert found(repair.repair(none)) == []
    empty = hashlib.sha256(b"").hexdigest()
    assert found(repair.repair(none, rows.filter("conv_id = 200"))) == [(200, 0, 0, 0, 0, 0, 0, "", empty)]


ROW = st.tuples(st.sampled_from("suat"), st.sampled_from([None, None, "blank", "duplicate", "truncated"]))


@settings(max_examples=400, deadline=None)
@given(st.lists(ROW, max_size=12))
def test_search_from_both_ends_equals_dynamic_program(rows):
    lattice = repair.Lattice([(r, f in ("blank", "duplicate"), f == "truncated") for r, f in rows])
    ways = [w for e in (repair.EMPTY, repair.ANSWER) if (w := lattice.best(repair.EMPTY, e))]
    assert min(ways) == best([(None, r, "", f) for r, f in rows])[:2]
