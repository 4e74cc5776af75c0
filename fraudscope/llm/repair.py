"""Repair of conversations: the cheapest edits that make the turns alternate, with the least audit string among equals.

A conversation's rows are the columns of an edit lattice; a node is (rows read, what the result ends in).  Keep, Rerole and Delete
read a row, Insert does not.  Two heaps search it from both ends; when they have met, all crossings of equal cost are
finished, and the least concatenation of forward and reverse audit wins.  An audit names its path, and two audits of the same cost at one node
never are prefix and whole (the rest would be inserts, which cost), so the least audit of a node serves every continuation.

Rows get their place in the conversation from a distributed sort; a search sees a chunk of at most ``chunk`` rows.  A conversation of
one chunk is settled there.  A longer one gets, from each chunk, the best audits between all pairs of ends, which are joined in order;
then its rows are written again chunk by chunk and hashed as a stream, so no task holds a long conversation's texts.

Edge cases: a null conversation id is one conversation and stays null; null turns come first and count in no gap; rows of one turn are
ordered by role and text; null roles and texts are one space (an illegal role, a blank text); empty texts are blank;
repeated rows are duplicates; a conversation without rows has zeros, an empty audit and the hash of the
empty string; an empty table has no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import batch, ship, stored
from .ranks import ranked

#: Costs of the edits.  Fixed values.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: What the result ends in.  EMPTY and ANSWER may end a conversation.
EMPTY, SYSTEM, QUESTION, ANSWER = range(4)
#: The role that an insert or rerole writes after each of them, and what the result ends in then.
NEXT = {EMPTY: ("user", QUESTION), SYSTEM: ("user", QUESTION), QUESTION: ("assistant", ANSWER), ANSWER: ("user", QUESTION)}
#: Role initials that may follow, with what the result ends in then.
KEEP = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): QUESTION, (SYSTEM, "u"): QUESTION, (ANSWER, "u"): QUESTION, (QUESTION, "a"): ANSWER}
LEGAL = {"su", "ua", "au"}
SPACE = " \t\n\x0b\x0c\r"


class Lattice:
    """``rows`` are (initial of the role, must go, truncated)."""

    def __init__(self, rows: list[tuple[str, bool, bool]]):
        self.rows = rows

    def _reading(self, i: int, q: int):
        initial, must_go, truncated = self.rows[i]
        yield "D", DELETE, q
        if not must_go:
            extra = TRUNCATED if truncated else 0
            if (q, initial) in KEEP:
                yield "K", extra, KEEP[q, initial]
            yield "R", REROLE + extra, NEXT[q][1]

    def after(self, i: int, q: int):
        """(edit, cost, node) of the edges that leave a node."""
        yield "I", INSERT, (i, NEXT[q][1])
        if i < len(self.rows):
            for edit, cost, r in self._reading(i, q):
                yield edit, cost, (i + 1, r)

    def before(self, i: int, q: int):
        """The edges that reach a node."""
        for p, (_, r) in NEXT.items():
            if r == q:
                yield "I", INSERT, (i, p)
        if i:
            for p in NEXT:
                for edit, cost, r in self._reading(i - 1, p):
                    if r == q:
                        yield edit, cost, (i - 1, p)

    def best(self, start: int, end: int) -> tuple[int, str] | None:
        """Cost and least audit of the cheapest edits that lead from one end to the other."""
        first, last = (0, start), (len(self.rows), end)
        # reached and settled nodes of both directions: node -> (cost, audit).  At equal cost the heap goes on along the rows, so that a node is
        # settled after all nodes that reach it for nothing.
        reached, settled = ({first: (0, "")}, {last: (0, "")}), ({}, {})
        heaps = [[(0, 0, first)], [(0, 0, last)]]
        found = (0, "") if first == last else None
        while heaps[0] and heaps[1] and (found is None or heaps[0][0][0] + heaps[1][0][0] <= found[0]):
            way = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
            cost, _, node = heapq.heappop(heaps[way])
            if node in settled[way] or cost > reached[way][node][0]:
                continue
            audit = reached[way][node][1]
            settled[way][node] = (cost, audit)
            for edit, more, other in (self.before if way else self.after)(*node):
                longer = (cost + more, edit + audit if way else audit + edit)
                if other in settled[1 - way]:
                    rest = settled[1 - way][other]
                    whole = (longer[0] + rest[0], rest[1] + longer[1] if way else longer[1] + rest[1])
                    found = whole if found is None else min(found, whole)
                if other not in settled[way] and (other not in reached[way] or longer < reached[way][other]):
                    reached[way][other] = longer
                    heapq.heappush(heaps[way], (longer[0], -other[0] if way else other[0], other))
        return found


def rewrite(state: int, audit: str, rows: list[tuple[str, str]]) -> tuple[int, list[str]]:
    """What the result ends in, and the ``role:text`` lines that the edits leave of ``rows``."""
    out, at = [], iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(at)
        if edit == "K":
            state = KEEP[state, role[:1]]
        elif edit != "D":
            role, state = NEXT[state]
        if edit != "D":
            out.append(f"{role}:{text}")
    return state, out


def _digest(parts) -> str:
    h = hashlib.sha256()
    for k, p in enumerate(parts):
        h.update((b"\n" if k else b"") + p.encode("utf-8", "surrogatepass"))
    return h.hexdigest()


#: What a chunk tells: ends of its turns and roles, counts, and its best audits (a settled conversation has its hash and one audit).
CHUNK = pa.schema([
    *((c, pa.int64()) for c in ("conv_id", "chunk", "turns", "low", "high", "illegal", "blank", "duplicate", "truncated")),
    *((c, pa.string()) for c in ("sha", "head", "tail")),
    ("ways", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))])


def _survey(size: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("rank")
        initials = [r[:1] for r in t.column("role").to_pylist()]
        faults = t.column("fault").to_pylist()
        turns = [x for x in t.column("turn").to_pylist() if x is not None]
        lattice = Lattice([(r, f in ("blank", "duplicate"), f == "truncated") for r, f in zip(initials, faults)])
        chunk = t.column("chunk")[0].as_py()
        sha = None
        if chunk == 0 and len(faults) < size:
            ways = [(EMPTY, e, *w) for e in (EMPTY, ANSWER) if (w := lattice.best(EMPTY, e))]
            ways = [min(ways, key=lambda w: w[2:])]
            rows = list(zip(t.column("role").to_pylist(), t.column("text").to_pylist()))
            sha = _digest(rewrite(EMPTY, ways[0][3], rows)[1])
        else:
            ways = [(s, e, *w) for s in (NEXT if chunk else (EMPTY,)) for e in NEXT if (w := lattice.best(s, e))]
        return pa.Table.from_pylist([dict(
            conv_id=t.column("conv_id")[0].as_py(), chunk=chunk, sha=sha, turns=len(set(turns)), low=min(turns, default=None), high=max(turns, default=None),
            head=initials[0], tail=initials[-1], illegal=sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
            blank=faults.count("blank"), duplicate=faults.count("duplicate"), truncated=faults.count("truncated"),
            ways=[dict(zip(("start", "end", "cost", "audit"), w)) for w in ways])], schema=CHUNK)

    return run


#: A long conversation; ``pieces`` are the edits of each chunk and what the result ended in before it.
WHOLE = pa.schema([
    *((c, pa.int64()) for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()),
    ("pieces", pa.list_(pa.struct([("chunk", pa.int64()), ("start", pa.int32()), ("audit", pa.string())])))])


def _unite(t: pa.Table) -> pa.Table:
    """The chunks of one conversation, in order, as one."""
    chunks = sorted(t.to_pylist(), key=lambda c: c["chunk"])
    best = {EMPTY: (0, "", ())}  # end -> cost, audit, lengths of the chunks' audits with the ends before them
    total = dict.fromkeys(("turns", "illegal", "blank", "duplicate", "truncated"), 0)
    low = high = tail = None
    for c in chunks:
        for k in total:
            total[k] += c[k]
        total["turns"] -= c["low"] is not None and c["low"] == high  # a turn that goes on from the chunk before
        total["illegal"] += tail is not None and tail + c["head"] not in LEGAL
        low, high, tail = c["low"] if low is None else low, high if c["high"] is None else c["high"], c["tail"]
        new = {}
        for w in c["ways"]:
            if w["start"] in best:
                cost, audit, cuts = best[w["start"]]
                one = (cost + w["cost"], audit + w["audit"], (cuts, len(w["audit"]), w["start"]))
                if w["end"] not in new or one[:2] < new[w["end"]][:2]:
                    new[w["end"]] = one
        best = new
    cost, audit, cuts = min((best[e] for e in (EMPTY, ANSWER) if e in best), key=lambda b: b[:2])
    pieces, end = [], len(audit)
    for c in reversed(chunks):
        cuts, length, start = cuts
        pieces.append(dict(chunk=c["chunk"], start=start, audit=audit[end - length: end]))
        end -= length
    gaps = 0 if low is None else high - low + 1 - total.pop("turns")
    total.pop("turns", None)
    return pa.Table.from_pylist([dict(conv_id=chunks[0]["conv_id"], gaps=gaps, **total, cost=cost, audit=audit, pieces=pieces)], schema=WHOLE)


def _hash_long(rows: DataFrame, whole: DataFrame) -> DataFrame:
    """``_conv, _sha`` of the conversations of several chunks: their rows are written again in chunks and hashed in order."""
    pieces = whole.filter("pieces is not null").select(F.col("conv_id").alias("_conv"), F.explode("pieces").alias("p")).select("_conv", F.col("p.chunk").alias("_chunk"), "p.start", "p.audit")
    mine = rows.join(pieces, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("chunk") == F.col("_chunk")))

    def write(t: pa.Table) -> pa.Table:
        t = t.sort_by("rank")
        texts = list(zip(t.column("role").to_pylist(), t.column("text").to_pylist()))
        lines = rewrite(t.column("start")[0].as_py(), t.column("audit")[0].as_py(), texts)[1]
        return pa.table({"conv_id": t.column("conv_id")[:1], "chunk": t.column("chunk")[:1], "lines": pa.array([lines], pa.list_(pa.string()))})

    written = mine.select("conv_id", "chunk", "rank", "role", "text", "start", "audit").groupBy("conv_id", "chunk").applyInArrow(write, "conv_id long, chunk long, lines array<string>")

    def stream(batches):
        now, h, begun = None, None, False
        for b in batches:
            for conv, lines in zip(b.column("conv_id").to_pylist(), b.column("lines").to_pylist()):
                if h is None or conv != now:
                    if h is not None:
                        yield batch(_conv=([now], pa.int64()), _sha=([h.hexdigest()], pa.string()))
                    now, h, begun = conv, hashlib.sha256(), False
                for line in lines:
                    h.update((b"\n" if begun else b"") + line.encode("utf-8", "surrogatepass"))
                    begun = True
        if h is not None:
            yield batch(_conv=([now], pa.int64()), _sha=([h.hexdigest()], pa.string()))

    return written.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(stream, "_conv long, _sha string")


def repair(rows: DataFrame, ids: DataFrame | None = None, chunk: int = 512) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of every conversation of ``ids`` (default: of
    ``rows``).  ``rows`` has conv_id, turn, role and text."""
    ship(rows.sparkSession)
    ids = rows if ids is None else ids
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    r = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    same = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    body = F.rtrim("text", F.lit(SPACE))
    placed = ranked(r, ["conv_id"], ["turn", "role", "text"]).withColumns({
        "chunk": F.floor(F.col("rank") / F.lit(chunk)).cast("long"), "same": same, "blank": body == "", "open": ~F.substring(body, -1, 1).isin(".", "!", "?")})
    placed = stored(placed, "turns")
    # a row is a duplicate behind the first of its kind; only what occurs again is joined
    seen = placed.filter("not blank").groupBy("conv_id", "same").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    seen = stored(seen.select(F.col("conv_id").alias("_conv"), F.col("same").alias("_same"), "first"), "repeats")
    marked = placed.join(seen, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("same") == F.col("_same")), "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("rank") > F.col("first"), "duplicate").when(F.col("open"), "truncated")
    marked = marked.select("conv_id", "chunk", "rank", "turn", "role", "text", fault.alias("fault"))
    surveyed = marked.groupBy("conv_id", "chunk").applyInArrow(_survey(chunk), from_arrow_schema(CHUNK))
    surveyed = stored(surveyed, "chunks")
    settled = surveyed.filter("sha IS NOT NULL").select(
        "conv_id", F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", "illegal",
        F.col("ways")[0]["cost"].alias("cost"), F.col("ways")[0]["audit"].alias("audit"), F.col("sha").alias("repaired_sha256"))
    united = surveyed.filter("sha IS NULL").groupBy("conv_id").applyInArrow(_unite, from_arrow_schema(WHOLE))
    whole = stored(settled.unionByName(united, allowMissingColumns=True), "whole")
    hashed = _hash_long(placed, whole)
    every = ids.select(F.col("conv_id").cast("long").alias("id")).distinct()
    out = every.join(whole, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    out = out.join(hashed, F.col("id").eqNullSafe(F.col("_conv")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    sha = F.coalesce("repaired_sha256", "_sha", F.sha2(F.lit("").cast("binary"), 256))
    return out.select(F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), sha.alias("repaired_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows damaged by the CRC-32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 removes ``.!?`` from it, 3 repeats the row, 4 makes it the user's.
    Nulls are one space (a null turn stays null as a turn)."""
    def plain(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(plain("text"), ".!?", "")).otherwise(plain("text"))
    role = F.when(kind == 4, "user").otherwise(plain("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1)))
    return conversations.filter(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def repaired(conversations: DataFrame) -> DataFrame:
    """The damaged conversations repaired, one row for each original id."""
    return repair(damaged(conversations), conversations)
