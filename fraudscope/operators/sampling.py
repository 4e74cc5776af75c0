"""Train/test split, quotas by hash, class weights, SMOTE.

Stratified split without one task per class
-------------------------------------------
Every row gets a 60-bit hash ``h`` of its key columns and the seed.  Per class the
test set is the ``round(f * n_c)`` rows with the smallest ``h``.  A class may hold
99.9 % of all rows, so ranking inside the class would be one giant task.  Instead:

1. rows are counted per (class, 16-bit hash prefix) with a partial aggregate; on
   that small table (65,536 rows per class) the prefix in which each class's quota
   runs out and the number still needed there are found;
2. the rows of that one prefix bucket per class (1/65,536 of the class's hashes) are
   counted per hash with a partial aggregate, and running sums over those counts give
   the exact threshold hash ``h*`` of each class;
3. the split itself is a projection, ``h <= h*[class]``: one scan, no shuffle.

The thresholds (one per class) are collected and inlined.  Rows with identical keys
share a hash.  With unique keys the per-class counts are exact.  With repeated keys the
group of rows at ``h*`` may be larger than what is left of the quota: given a unique
``row_id``, the split takes the missing rows of that one group by the hash of their id,
so that counts are exact and all other groups stay whole; without one the whole group
is taken, and a class gets up to that group's size less one too many.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

N_BUCKET_BITS = 16


def row_hash(cols: list, seed: int = 42) -> Column:
    """Non-negative 60-bit hash of the key columns and the seed (partitioning-independent)."""
    key = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) if isinstance(c, str) else c for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def _typed_map(d: dict, value_type: str, key_type: str | None = None) -> Column:
    def key(k):
        return F.lit(k).cast(key_type) if key_type else F.lit(k)
    return F.create_map(*[x for k, v in d.items() for x in (key(k), F.lit(v).cast(value_type))])


@dataclass(frozen=True)
class Thresholds:
    """Per-class hash thresholds (classes with quota 0 are absent) and the label's SQL type.  ``rest``: for classes whose rows at the
    threshold itself are more than the quota has room for, how many of them fit."""
    key_type: str
    values: dict
    rest: dict = field(default_factory=dict)


def hash_thresholds(df: DataFrame, label: str, key_cols: list, seed: int = 42,
                    quotas: dict | None = None, fraction: float | None = None) -> Thresholds:
    """Per class: the largest hash among its ``quota`` smallest hashes (classes with quota 0 are absent).

    ``quotas`` gives the count per class; otherwise ``round(fraction * n_class)``.
    """
    ktype = dict(df.dtypes)[label]
    hashed = df.select(F.col(label).alias("_y"), row_hash(key_cols, seed).alias("_h")).filter(F.col("_y").isNotNull())
    hashed = hashed.withColumn("_hb", F.shiftright(F.col("_h"), 60 - N_BUCKET_BITS))
    counts = hashed.groupBy("_y", "_hb").agg(F.count(F.lit(1)).alias("_n"))
    # one job on the small count table: class totals, quotas, running counts, the cut-off bucket
    total = F.sum("_n").over(Window.partitionBy("_y"))
    if quotas is None:
        q = F.floor(F.col("_total").cast("double") * F.lit(float(fraction)) + F.lit(0.5)).cast("long")
    else:
        q = F.coalesce(_typed_map(quotas, "long", ktype)[F.col("_y")], F.lit(0).cast("long"))
    w = Window.partitionBy("_y").orderBy("_hb").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut_rows = (counts.withColumn("_total", total).withColumn("_q", F.least(q, F.col("_total")))
                .withColumn("_cum", F.sum("_n").over(w)).withColumn("_before", F.col("_cum") - F.col("_n"))
                .filter((F.col("_q") > 0) & (F.col("_before") < F.col("_q")) & (F.col("_cum") >= F.col("_q")))
                .select("_y", "_hb", (F.col("_q") - F.col("_before")).alias("_need")).collect())  # one row per class
    cut = {r["_y"]: (int(r["_hb"]), int(r["_need"])) for r in cut_rows}
    if not cut:
        return Thresholds(ktype, {})
    cond = None
    for y, (hb, _) in cut.items():
        c = (F.col("_y") == F.lit(y).cast(ktype)) & (F.col("_hb") == F.lit(hb))
        cond = c if cond is None else cond | c
    need = _typed_map({y: n for y, (_, n) in cut.items()}, "long", ktype)
    w_in = Window.partitionBy("_y").orderBy("_h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = need[F.col("_y")] - (F.col("_cum") - F.col("_n"))  # of the quota, before this hash
    thr = (hashed.filter(cond).groupBy("_y", "_h").agg(F.count(F.lit(1)).alias("_n")).withColumn("_cum", F.sum("_n").over(w_in))
           .withColumn("_left", left).filter((F.col("_left") > 0) & (F.col("_left") <= F.col("_n")))
           .select("_y", "_h", "_n", "_left").collect())  # one row per class
    return Thresholds(ktype, {r["_y"]: int(r["_h"]) for r in thr}, {r["_y"]: int(r["_left"]) for r in thr if r["_left"] < r["_n"]})


def in_quota(label: str, key_cols: list, thresholds: Thresholds, seed: int = 42) -> Column:
    """Boolean column: the row's hash is within its class threshold."""
    if not thresholds.values:
        return F.lit(False)
    thr = _typed_map(thresholds.values, "long", thresholds.key_type)[F.col(label)]
    return F.coalesce(row_hash(key_cols, seed) <= thr, F.lit(False))


def stratified_split(
    df: DataFrame,
    label: str,
    key_cols: list,
    test_fraction: float = 0.2,
    seed: int = 42,
    split_col: str = "split",
    row_id: str | None = None,
) -> DataFrame:
    """Return ``df`` with ``split_col`` = 'test' / 'train' (per-class test counts round(f * n_c)).

    ``row_id``: a column of unique ids; needed for exact counts where keys repeat.
    """
    thr = hash_thresholds(df, label, key_cols, seed, fraction=test_fraction)
    test = in_quota(label, key_cols, thr, seed)
    if row_id and thr.rest:
        at = _typed_map({y: thr.values[y] for y in thr.rest}, "long", thr.key_type)[F.col(label)]
        cut = F.coalesce(row_hash(key_cols, seed) == at, F.lit(False))  # the rows of the one group that is split
        by_id = hash_thresholds(df.filter(cut), label, [row_id], seed, quotas=thr.rest)
        test = test & (~cut | in_quota(label, [row_id], by_id, seed))
    return df.withColumn(split_col, F.when(test, "test").otherwise("train"))


def hash_fraction_split(df: DataFrame, key_cols: list, test_fraction: float = 0.2, seed: int = 42,
                        split_col: str = "split") -> DataFrame:
    """Unstratified split by hash only: no shuffle at all (approximately ``test_fraction``)."""
    h = row_hash(key_cols, seed).cast("double") / F.lit(float(2 ** 60))
    return df.withColumn(split_col, F.when(h < F.lit(test_fraction), "test").otherwise("train"))


def seeded_shuffle(df: DataFrame, key_cols: list, seed: int = 42) -> DataFrame:
    """Rows in a pseudo-random order fixed by (seed, key) — a range-partitioned sort on the key
    hash, so the order does not depend on partitioning and no task holds more than its range."""
    return df.orderBy(row_hash(key_cols, seed))


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).cast("long").alias("n"))


def balanced_class_weights(df: DataFrame, label: str, digits: int = 6) -> DataFrame:
    """(label, n, weight) with weight = n_total / (n_classes * n_c)."""
    counts = class_counts(df, label)
    tot = counts.agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("k")).first()
    return counts.withColumn(
        "weight", F.round(F.lit(float(tot["t"])) / (F.lit(float(tot["k"])) * F.col("n").cast("double")), digits)
    )


def positive_class_weight(df: DataFrame, label: str) -> DataFrame:
    """One row: n_pos, n_neg, label_rate, scale_pos_weight = round(n_neg / max(n_pos, 1), 2)."""
    y = F.col(label).cast("int")
    agg = df.agg(F.count_if(y == 1).alias("n_pos"), F.count_if(y == 0).alias("n_neg"), F.avg(y.cast("double")).alias("label_rate"))
    return agg.select(
        F.col("n_pos").cast("long").alias("n_pos"),
        F.col("n_neg").cast("long").alias("n_neg"),
        F.round("label_rate", 6).alias("label_rate"),
        F.round(F.col("n_neg").cast("double") / F.greatest(F.col("n_pos"), F.lit(1)).cast("double"), 2).alias("scale_pos_weight"),
    )


def with_weights(df: DataFrame, label: str, weights: dict, col: str = "weight") -> DataFrame:
    m = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
    return df.withColumn(col, F.coalesce(F.try_element_at(m, F.col(label)), F.lit(1.0)))


def mark_smallest_hash(df: DataFrame, label: str, key_cols: list, quotas: dict, seed: int = 42,
                       flag: str = "picked") -> DataFrame:
    """Flag exactly ``quotas[label]`` rows per label (unique keys): those with the smallest key hash."""
    thr = hash_thresholds(df, label, key_cols, seed, quotas=quotas)
    return df.withColumn(flag, in_quota(label, key_cols, thr, seed))


def _u(seed: int, tag: str, *cols) -> Column:
    """Deterministic uniform [0, 1) from (seed, tag, cols)."""
    key = F.concat_ws("|", F.lit(str(seed)), F.lit(tag), *[F.col(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(16 ** 13))


def smote(df: DataFrame, label: str, vec_col: str, id_col: str, k: int = 5, seed: int = 42,
          block_rows: int | None = None) -> DataFrame:
    """M8: oversample every class below the majority size up to it, SMOTE style.

    Output: ``df``'s (id, label, vec) rows with ``synthetic = false`` plus the new
    rows (``synthetic = true``, id NULL).  For a class of n_c rows that needs
    n_need extra rows, every row is the base of ``n_need // n_c`` samples and the
    ``n_need % n_c`` rows with the smallest hash of one more, so the class ends up
    exactly at the majority size.  For each sample a neighbour among the k
    nearest of the same class and a gap in [0, 1) are drawn from hashes of
    (seed, row id, sample number): the result does not depend on partitioning.
    New point = base + gap * (neighbour - base).
    """
    from .knn import DEFAULT_BLOCK_ROWS, knn_same_class

    counts = {r[label]: int(r["n"]) for r in class_counts(df, label).collect()}  # one row per class
    if not counts:
        return df
    n_major = max(counts.values())
    need = {c: n_major - n for c, n in counts.items() if n < n_major}
    base_cols = df.select(F.col(id_col).alias("id"), F.col(label).alias("label"),
                          F.col(vec_col).cast("array<double>").alias("vec"),
                          F.lit(False).alias("synthetic"))
    if not need:
        return base_cols
    small = [c for c in need if counts[c] <= k]
    if small:
        raise ValueError(f"Expected n_neighbors <= n_samples: classes {small} have <= {k} rows")
    minority = base_cols.filter(F.col("label").isin(list(need)))
    nbrs = knn_same_class(minority, "id", "label", "vec", k=k, block_rows=block_rows or DEFAULT_BLOCK_ROWS,
                          n_rows=sum(counts[c] for c in need))
    # at most k rows per id: a bounded list, with the neighbours' vectors (k rows per minority row, whatever the sample count)
    found = nbrs.select("id", "rank", "neighbor_id").join(minority.select(F.col("id").alias("neighbor_id"), F.col("vec").alias("nvec")), "neighbor_id")
    nbr_lists = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "nvec"))).alias("nl"))
    nbr_lists = nbr_lists.select("id", F.transform("nl", lambda s: s["nvec"]).alias("nbr_vecs"))
    per = {c: need[c] // counts[c] for c in need}
    extra = {c: need[c] % counts[c] for c in need}
    flagged = mark_smallest_hash(minority.select("id", "label"), "label", ["id"], extra, seed=seed, flag="_extra")
    pm = F.create_map(*[x for c, v in per.items() for x in (F.lit(c), F.lit(int(v)))])
    reps = flagged.withColumn("_m", F.try_element_at(pm, F.col("label")) + F.col("_extra").cast("int")).filter(F.col("_m") > 0)
    # both vectors come to the base row; the synthetic rows are made from it after the last shuffle
    bases = reps.join(nbr_lists, "id").join(minority.select("id", "vec"), "id")
    samples = bases.withColumn("s", F.explode(F.sequence(F.lit(1), F.col("_m"))))
    samples = samples.withColumn(
        "nvec", F.col("nbr_vecs")[F.floor(_u(seed, "n", "id", "s") * F.size("nbr_vecs")).cast("int")]
    ).withColumn("gap", _u(seed, "g", "id", "s"))
    synth = samples.select(
        F.lit(None).cast(base_cols.schema["id"].dataType).alias("id"), "label",
        F.zip_with("vec", "nvec", lambda a, b: a + F.col("gap") * (b - a)).alias("vec"),
        F.lit(True).alias("synthetic"),
    )
    return base_cols.unionByName(synth)
