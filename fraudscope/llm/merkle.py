"""Merkle manifest of a dataset: a hash tree over the rows of each group, a tree over the groups, and a proof for every row.

The tree is a rollup of nested structs.  A leaf's rank inside its group is written in digits of base ``fan``; the lowest ``levels``
digits are grouped away one after the other inside a block of ``fan ** levels`` leaves, each step nesting the child structs
in their parent, so that one shuffle by block builds all its levels and a block's row stays small whatever the group holds.  The
blocks' own digests are rolled up in the same way until each group has one node; then the groups' nodes are.  On the
way down a transform gives each child the digests beside it and an explode makes it a row: proofs need no join.  A
block from below meets its path from above by grouping the two rows that carry its number.

Edge cases: null is ``-`` in a leaf and sorts first; null groups are one group; rows equal in group and order are told apart by their
digests, rows equal in all columns are leaves of their own with equal digests; empty texts have zero bytes; an empty
table has no rows and no root; a lone leaf is its group's node and, alone in the table, the root with an empty
proof; columns that are not named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .ranks import ranked

#: The columns of a document that its leaf covers, in order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(columns: list[Column]) -> Column:
    """Digest of a row: each value ``-`` if null, else its UTF-8 byte count, a colon and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _digest(parts: Column) -> Column:
    return F.sha2(F.array_join(parts, "").cast("binary"), 256)


def _rollup(nodes: DataFrame, fan: int, levels: int) -> DataFrame:
    """``grp, block, n, h, tree`` from ``grp, rank, n, h, item``; n nodes are in the group.  A level with a single node is passed on unhashed."""
    digits = {f"d{k}": (F.floor(F.col("rank") / F.lit(fan**k)) % fan).cast("int") for k in range(levels)}
    block = F.floor(F.col("rank") / F.lit(fan**levels)).cast("long")
    x = nodes.withColumns({**digits, "block": block}).withColumn("tree", F.struct("item")).repartition("grp", "block")
    for k in range(levels):
        keys = ["grp", "block", "n", *(f"d{j}" for j in range(k + 1, levels))]
        x = x.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(f"d{k}", "h", "tree"))).alias("kids"))
        h = F.when(F.col("n") > fan**k, _digest(F.col("kids.h"))).otherwise(F.col("kids")[0]["h"])
        x = x.withColumn("h", h).withColumn("tree", F.struct("kids")).drop("kids")
    return x.select("grp", "block", "n", "h", "tree")


def _unfold(blocks: DataFrame, fan: int, levels: int, carried: list[str]) -> DataFrame:
    """``item``, ``h`` and ``carried`` of every node below the blocks, with ``path`` from the node up (``left`` and ``right`` digests of each level)."""
    x = blocks.withColumn("h", F.lit(""))
    for k in range(levels - 1, -1, -1):
        kids = F.col("tree.kids")
        beside = F.transform(kids, lambda kid, i: F.struct(
            kid["h"].alias("h"), kid["tree"].alias("tree"),
            F.array_join(F.slice(kids["h"], F.lit(1), i), "").alias("left"),
            F.array_join(F.slice(kids["h"], i + 2, F.lit(fan)), "").alias("right")))
        x = x.select(*carried, "n", "path", F.explode(beside).alias("kid"))
        step = F.array(F.struct(F.col("kid.left").alias("left"), F.col("kid.right").alias("right")))
        path = F.when(F.col("n") > fan**k, F.concat(step, F.col("path"))).otherwise(F.col("path"))
        x = x.select(*carried, "n", path.alias("path"), F.col("kid.h").alias("h"), F.col("kid.tree").alias("tree"))
    return x.select(*carried, "path", "h", F.col("tree.item").alias("item"))


def _climb(nodes: DataFrame, fan: int, levels: int) -> list[DataFrame]:
    """The stored blocks of each stage; those of the last stage hold one whole group each."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    stages = [stored(_rollup(nodes, fan, levels), "merkle")]
    while most > fan**levels:
        below = F.ceil(F.col("n") / F.lit(fan**levels)).cast("long")
        up = stages[-1].select("grp", F.col("block").alias("rank"), below.alias("n"), "h", F.struct(F.col("block").alias("number")).alias("item"))
        stages.append(stored(_rollup(up, fan, levels), "merkle"))
        most = -(-most // fan**levels)
    return stages


def _descend(stages: list[DataFrame], tops: DataFrame, fan: int, levels: int, carried: list[str]) -> DataFrame:
    """``item, h, path, carried`` of the first stage's nodes; ``tops`` has ``grp, path, carried`` of each group."""
    paths = tops.withColumn("block", F.lit(0).cast("long"))
    for k in range(len(stages) - 1, -1, -1):
        both = stages[k].drop("h").unionByName(paths, allowMissingColumns=True)
        once = [F.first(c, ignorenulls=True).alias(c) for c in ("n", "tree", "path", *carried)]
        met = both.groupBy("grp", "block").agg(*once)
        out = _unfold(met, fan, levels, ["grp", *carried])
        if k:
            paths = out.select("grp", F.col("item.number").alias("block"), "path", *carried)
    return out


def manifest(rows: DataFrame, group: str, order: str, columns=COLUMNS, extra: dict[str, Column] | None = None, fan: int = 3, levels: int = 6) -> DataFrame:
    """``order, leaf, subroot, root, path`` and the ``extra`` columns of every row.  ``path`` has the digests left and right of the row's
    node, level by level from the leaf to the root."""
    extra = extra or {}
    kept = F.struct(F.col(order).alias("key"), *(v.alias(k) for k, v in extra.items()))
    leaves = stored(rows.select(F.col(group).alias("grp"), leaf([F.col(c) for c in columns]).alias("h"), kept.alias("item")), "leaves")
    sizes = stored(leaves.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), "sizes")
    placed = ranked(leaves.withColumn("key", F.col("item.key")), ["grp"], ["key", "h"])
    sized = placed.join(sizes.withColumnRenamed("grp", "_grp"), F.col("grp").eqNullSafe(F.col("_grp"))).select("grp", "rank", "n", "h", "item")
    inside = _climb(sized, fan, levels)

    subroots = inside[-1].select(F.lit(0).alias("grp"), F.col("grp").alias("key"), "h", F.struct(F.col("grp").alias("of")).alias("item"))
    groups = sizes.count()
    above = _climb(ranked(subroots, ["grp"], ["key"]).withColumn("n", F.lit(groups).cast("long")), fan, levels)
    top = above[-1].select("grp", F.array().cast("array<struct<left:string,right:string>>").alias("path"), F.col("h").alias("root"))
    tops = _descend(above, top, fan, levels, ["root"]).select(F.col("item.of").alias("grp"), "path", "root", F.col("h").alias("subroot"))
    out = _descend(inside, tops, fan, levels, ["root", "subroot"])
    return out.select(F.col("item.key").alias(order), F.col("h").alias("leaf"), "subroot", "root", "path", *(F.col(f"item.{k}").alias(k) for k in extra))


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest leads to along its path."""
    return F.aggregate(path, digest, lambda h, step: F.sha2(F.concat(step["left"], h, step["right"]).cast("binary"), 256))


def siblings(path: Column) -> Column:
    """All digests of a path in one string, leaf to root, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def proven(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents`` by ``source``, verified against rows of which some were tampered with: where the CRC-32 of the
    decimal ``doc_id`` is even, the text's line feeds are gone (a null id or text is left alone)."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    columns = [F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")) if c == "text" else F.col(c) for c in COLUMNS]
    touched = F.when(hit & F.contains("text", F.lit("\n")), leaf(columns))
    out = manifest(docs, "source", "doc_id", extra={"tampered": touched})
    out = out.withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("path")))
    proof = F.sha2(siblings(F.col("path")).cast("binary"), 256)
    return out.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: The same rows in DuckDB.  CRC-32 is written out bit by bit (polynomial 0xEDB88320).
SQL = """
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id, source,
    CASE WHEN xor(list_reduce(string_split(doc_id::VARCHAR, ''),
      lambda crc, c: list_reduce(range(8), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, xor(crc, ascii(c)::BIGINT)),
      4294967295::BIGINT), 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head, text
  FROM documents),
leaves AS (
  SELECT r, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(changed) || ':' || changed, '-')) AS tampered
  FROM docs),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, count(*) OVER (PARTITION BY source) AS n FROM leaves),
up AS (
  SELECT 0 AS lvl, source, rank, n, leaf AS h FROM placed
  UNION ALL
  SELECT lvl + 1, source, rank // 3, max((n + 2) // 3), sha256(string_agg(h, '' ORDER BY rank)) FROM up WHERE n > 1 GROUP BY lvl, source, rank // 3),
subroots AS (
  SELECT source, h AS subroot, lvl AS height, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS rank, count(*) OVER () AS n FROM up WHERE n = 1),
above AS (
  SELECT 0 AS lvl, rank, n, subroot AS h FROM subroots
  UNION ALL
  SELECT lvl + 1, rank // 3, max((n + 2) // 3), sha256(string_agg(h, '' ORDER BY rank)) FROM above WHERE n > 1 GROUP BY lvl, rank // 3),
root AS (SELECT h AS root FROM above WHERE n = 1),
inner_steps AS (
  SELECT u.source, u.lvl, u.rank, coalesce(string_agg(s.h, '' ORDER BY s.rank) FILTER (s.rank < u.rank), '') AS l,
    coalesce(string_agg(s.h, '' ORDER BY s.rank) FILTER (s.rank > u.rank), '') AS rr
  FROM up u JOIN up s ON s.source IS NOT DISTINCT FROM u.source AND s.lvl = u.lvl AND s.rank // 3 = u.rank // 3 WHERE u.n > 1 GROUP BY ALL),
outer_steps AS (
  SELECT u.lvl, u.rank, coalesce(string_agg(s.h, '' ORDER BY s.rank) FILTER (s.rank < u.rank), '') AS l,
    coalesce(string_agg(s.h, '' ORDER BY s.rank) FILTER (s.rank > u.rank), '') AS rr
  FROM above u JOIN above s ON s.lvl = u.lvl AND s.rank // 3 = u.rank // 3 WHERE u.n > 1 GROUP BY ALL),
steps AS (
  SELECT p.r, i.lvl, l, rr FROM placed p JOIN inner_steps i ON i.source IS NOT DISTINCT FROM p.source AND i.rank = p.rank // (3 ** i.lvl)::BIGINT
  UNION ALL
  SELECT p.r, s.height + o.lvl, l, rr FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source JOIN outer_steps o ON o.rank = s.rank // (3 ** o.lvl)::BIGINT),
paths AS (SELECT r, string_agg(l || rr, '' ORDER BY lvl) AS proof, list({'l': l, 'r': rr} ORDER BY lvl) AS path FROM steps GROUP BY r)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM (SELECT p.doc_id, p.leaf, s.subroot, root, proof,
    list_reduce(list_transform(coalesce(path, []), lambda x: x.l || ',' || x.r), lambda h, x: sha256(split_part(x, ',', 1) || h || split_part(x, ',', 2)), p.tampered) AS folded_root
  FROM placed p LEFT JOIN paths t USING (r) JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source CROSS JOIN root)
"""
