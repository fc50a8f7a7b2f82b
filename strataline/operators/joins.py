"""Registry joins; overlapping columns are merged. Missing keys match nothing unless ``na_matches=True``, which is how the cohort
scripts join: with many missing keys on both sides the result then grows with their product."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import merge_cells
from ..session import materialise
from .columns import name_union
from .ordered import ordered_scan
from .skew import attach_size, full_join, same_key


def left_join(left: DataFrame, right: DataFrame, keys: Sequence[str], na_matches: bool = False,
              suffix: tuple[str, str] = (".x", ".y")) -> DataFrame:
    """Left join; keys come once, other shared columns get the suffixes. Spark chooses broadcast or
    shuffle by size and splits hot partitions of the left side."""
    shared = [c for c in left.columns if c in right.columns and c not in keys]
    left = left.withColumnsRenamed({c: c + suffix[0] for c in shared})
    right = right.withColumnsRenamed({**{c: c + suffix[1] for c in shared}, **{k: f"__r_{k}" for k in keys}})
    on = same_key(left, right, [(k, f"__r_{k}") for k in keys], na_matches)
    return left.join(right, on, "left").drop(*[f"__r_{k}" for k in keys])


def full_join_first_known(left: DataFrame, right: DataFrame, keys: Sequence[str],
                          shared: Sequence[str] | None = None, na_matches: bool = False) -> DataFrame:
    """Full outer join; each shared column keeps the left value, else the right one."""
    out = full_join(left, right, keys, na_matches)
    both = [c for c in left.columns if c in right.columns and c not in keys]
    out = out.withColumns({c: F.coalesce(F.col(f"`{c}.x`"), F.col(f"`{c}.y`")) for c in (shared or both)})
    return out.drop(*[f"{c}{s}" for c in both for s in (".x", ".y")])


def coalesce_join(left: DataFrame, right: DataFrame, keys: Sequence[str], na_matches: bool = False) -> DataFrame:
    """Full outer join that merges each shared column: equal values stay, a missing one is filled
    from the other side, different ones become the union of their lines."""
    both = [c for c in left.columns if c in right.columns and c not in keys]
    text = {c: F.col(f"`{c}`").cast("string") for c in both if
            left.schema[c].dataType != right.schema[c].dataType
            or left.schema[c].dataType.simpleString() != "string"}
    left, right = left.withColumns(text), right.withColumns(text)
    out = full_join(left, right, keys, na_matches)
    merged = {c: merge_cells(F.col(f"`{c}.x`"), F.col(f"`{c}.y`")).alias(c) for c in both}
    return out.select(*[merged.get(c, F.col(f"`{c}`")) for c in name_union(left, right)])


def semi_join(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows of ``left`` with a partner; pairs may cross, as in ``[("lhs", "rhs"), ("rhs", "lhs")]``."""
    keys = right.select(*[F.col(b).alias(f"__{i}") for i, (_, b) in enumerate(pairs)]).distinct()
    return left.join(keys, same_key(left, keys, [(a, f"__{i}") for i, (a, _) in enumerate(pairs)], True), "left_semi")


def anti_join(left: DataFrame, right: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Rows of ``left`` without a partner on the keys (all shared columns by default)."""
    keys = list(keys or [c for c in left.columns if c in right.columns])
    other = right.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    return left.join(other, same_key(left, other, [(k, f"__{k}") for k in keys], True), "left_anti")


def grid(rows: DataFrame, columns: DataFrame, within: Sequence[str] = (), spread: int | None = None) -> DataFrame:
    """Every row key with every column key (inside each ``within`` key): the result is the grid.

    Rows get one of ``spread`` buckets and the column keys are repeated per bucket, so the cells are
    produced by many tasks even for one hot ``within`` key. Without ``spread`` there are four buckets per
    shuffle partition, so they grow with the cluster's setting for the data. Use it only where the cells
    themselves are wanted; counts come from the sparse calls (absent = total - present).
    """
    spread = spread or 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.pmod(F.xxhash64(*rows.columns), F.lit(spread)).cast("int")
    left = rows.withColumn("__bucket", bucket)
    right = columns.withColumn("__bucket", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    return left.join(right, ["__bucket", *within]).drop("__bucket")


def fill_grid(cells: DataFrame, observed: DataFrame, keys: Sequence[str], defaults: dict) -> DataFrame:
    """Left-join observations to the grid and fill what is absent."""
    return left_join(cells, observed, keys, na_matches=False).na.fill(defaults)


def pair_methods(df: DataFrame, method: str, target: str, comparator: str, keys: Sequence[str],
                 value: str) -> DataFrame:
    """Values of two methods side by side, paired on the keys (full join)."""
    side = lambda m, name: df.filter(F.col(method) == m).select(*keys, F.col(value).alias(name))
    return full_join(side(target, "target"), side(comparator, "comparator"), keys, na_matches=False)


def with_at_least(df: DataFrame, keys: Sequence[str], rows: int = 2) -> DataFrame:
    """Rows of groups that have at least this many rows."""
    return attach_size(df, keys, "__n").filter(F.col("__n") >= rows).drop("__n")


def enrich(df: DataFrame, lookup: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Columns of a small table by key; Spark broadcasts it after checking its size."""
    return left_join(df, lookup, keys, na_matches=False)


def link_registries(first: DataFrame, steps: Sequence[tuple[DataFrame, Sequence[str]]], natural_keys: Sequence[str],
                    key: str = "key_id", na_matches: bool = False) -> DataFrame:
    """Cascade of full joins, each on its own keys, then one number per linked person.

    Numbers follow the sorted natural keys, so a rerun gives the same ones; the numbering runs over
    range-partitioned pieces, not in one task.
    """
    linked = first
    for other, keys in steps:
        # each step is read twice by the next one (measured, then joined), so it is written once
        linked = materialise(full_join_first_known(linked, other, keys, na_matches=na_matches))
    numbered = ordered_scan(linked, [], list(natural_keys), row_number=key)
    return numbered.withColumn(key, F.col(key).cast("string"))
