"""Column-name helpers (metadata only; no Spark job)."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame

_UPPER, _BREAKS = set(string.ascii_uppercase), set(string.ascii_lowercase + string.digits)
_SEPARATORS = {" ", "-"}


def to_snake_case(name: str) -> str:
    """A capital after a small letter or digit starts a new word; words are joined by underscores, as are the parts of a name
    around blanks and dashes (``oldbalanceOrg`` -> ``oldbalance_org``; runs of capitals such as ``ID`` stay one word)."""
    words = [""]
    for ch in name:
        if ch in _UPPER and words[-1][-1:] in _BREAKS:
            words.append("")
        words[-1] += "_" if ch in _SEPARATORS else ch
    return "_".join(words).lower()


def standardise_column_names(df: DataFrame) -> DataFrame:
    """Rename every column to snake_case; raise if two columns collide."""
    mapping = {c: to_snake_case(c) for c in df.columns}
    targets = list(mapping.values())
    dupes = sorted({t for t in targets if targets.count(t) > 1})
    if dupes:
        raise ValueError(f"Column names collide after snake_case: {dupes}")
    changed = {k: v for k, v in mapping.items() if k != v}
    return df.withColumnsRenamed(changed) if changed else df


def common_columns(reference: DataFrame, current: DataFrame) -> list[str]:
    """Columns present in both tables, in the reference's order."""
    cur = set(current.columns)
    return [c for c in reference.columns if c in cur]


def missing_columns(df: DataFrame, required) -> list[str]:
    have = set(df.columns)
    return sorted(c for c in required if c not in have)
