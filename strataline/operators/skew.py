"""Joins that stay balanced when one key holds a large share of the rows.

Two tools:

* ``full_join`` writes the hot part of a full outer join as an inner and two anti joins. Spark can
  split hot partitions of inner and anti joins at run time, but not of a full outer join.
* ``attach`` joins per-key figures back to the rows. The figures come out of an aggregate, so Spark
  cannot split that join by itself; keys above the row limit are spread over several salts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import group_rows, materialise


def same_key(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]],
             na_matches: bool) -> Column:
    """Equality over key pairs; with ``na_matches`` a missing key equals a missing key."""
    tests = [left[a].eqNullSafe(right[b]) if na_matches else left[a] == right[b] for a, b in pairs]
    return reduce(lambda x, y: x & y, tests)


def own_exchange(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], how: str) -> DataFrame:
    """Semi or anti join on equal keys where ``right`` comes out of an aggregate.

    Joined on the plain keys Spark reuses the aggregate's partitioning and then cannot split a hot key of ``left``. The hash of the
    keys is a partitioning of its own, so both sides are dealt anew and adaptive execution can split. Missing keys match nothing.
    """
    hashed = right.select(F.xxhash64(*[F.col(f"`{b}`") for _, b in pairs]).alias("__hash"), *[F.col(f"`{b}`").alias(f"__o_{i}") for i, (_, b) in enumerate(pairs)])
    marked = left.withColumn("__mine", F.xxhash64(*[F.col(f"`{a}`") for a, _ in pairs]))
    on = marked["__mine"] == hashed["__hash"]
    for i, (a, _) in enumerate(pairs):
        on = on & (marked[f"`{a}`"] == hashed[f"__o_{i}"])
    return marked.join(hashed, on, how).drop("__mine")


def without_partner(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return own_exchange(left, right.select(*keys).distinct(), [(k, k) for k in keys], "left_anti")


def hot_keys(frames: Sequence[DataFrame], keys: Sequence[str], limit: int) -> DataFrame | None:
    """Keys with more than ``limit`` rows in one of the frames, or None. One job over the key columns."""
    counted = [f.select(*[F.col(f"`{k}`").alias(f"__h_{k}") for k in keys], F.lit(i).alias("__side"))
               for i, f in enumerate(frames)]
    names = [f"__h_{k}" for k in keys]
    many = reduce(lambda a, b: a.union(b), counted).groupBy(*names, "__side").agg(
        F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > limit).select(*names).distinct()
    return None if many.isEmpty() else materialise(many)


def full_join(left: DataFrame, right: DataFrame, keys: Sequence[str], na_matches: bool = False,
              suffix: tuple[str, str] = (".x", ".y")) -> DataFrame:
    """Full outer join; keys come once, other shared columns get the suffixes.

    Without hot keys this is one full outer join. Rows of hot keys (their list is bounded by rows /
    limit, so it is broadcast) go through an inner join and two anti joins instead.
    """
    keys = list(keys)
    shared = [c for c in left.columns if c in right.columns and c not in keys]
    left = left.withColumnsRenamed({c: c + suffix[0] for c in shared})
    right = right.withColumnsRenamed({c: c + suffix[1] for c in shared})
    names = [*left.columns, *[c for c in right.columns if c not in keys]]
    hot = hot_keys([left, right], keys, group_rows(left.sparkSession))
    right_keys = {k: f"__right_{k}" for k in keys}

    def outer(x: DataFrame, y: DataFrame) -> DataFrame:
        # the flags tell an absent side from a present one whose key is missing
        x, y = x.withColumn("__l", F.lit(True)), y.withColumnsRenamed(right_keys)
        out = x.join(y, same_key(x, y, list(right_keys.items()), na_matches), "full")
        return out.select(*[F.when(F.col("__l"), F.col(f"`{c}`")).otherwise(F.col(f"`{right_keys[c]}`")).alias(c)
                            if c in keys else F.col(f"`{c}`") for c in names])

    if hot is None:
        return outer(left, right)

    def part(df: DataFrame, how: str) -> DataFrame:
        return df.join(F.broadcast(hot), same_key(df, hot, [(k, f"__h_{k}") for k in keys], True), how)

    x, y = part(left, "left_semi"), part(right, "left_semi").withColumnsRenamed(right_keys)
    on = same_key(x, y, list(right_keys.items()), na_matches)
    both = x.join(y, on, "inner").drop(*right_keys.values())
    y_only = y.join(x, on, "left_anti").withColumnsRenamed({v: k for k, v in right_keys.items()})
    pieces = [both, x.join(y, on, "left_anti"), y_only]
    split = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), pieces)
    return outer(part(left, "left_anti"), part(right, "left_anti")).unionByName(split.select(*[F.col(f"`{c}`") for c in names]))


def attach(df: DataFrame, figures: DataFrame, keys: Sequence[str], size: str = "n",
           how: str = "left", keep_size: bool = True) -> DataFrame:
    """Join per-key ``figures`` (one row per key, ``size`` = rows of that key in ``df``) to ``df``.

    Keys with more than ``strataline.group_rows`` rows are few by construction (their number is at
    most rows / limit), so their list is broadcast; their rows get one of several salts and the
    figure row is repeated per salt.
    """
    keys = list(keys)
    limit = group_rows(df.sparkSession)
    salts = F.ceil(F.col(size) / limit).cast("int")
    hot = figures.filter(F.col(size) > limit).select(
        *[F.col(k).alias(f"__hot_{k}") for k in keys], salts.alias("__salts"))
    match = reduce(lambda a, b: a & b, [df[k].eqNullSafe(hot[f"__hot_{k}"]) for k in keys])
    # the salt depends on the row and its input split, so a recomputed task gives the same salt
    row_hash = F.pmod(F.xxhash64(*df.columns, F.spark_partition_id()), F.col("__salts"))
    salted = df.join(F.broadcast(hot), match, "left").withColumn(
        "__salt", F.coalesce(row_hash, F.lit(0)).cast("int")).drop(
        "__salts", *[f"__hot_{k}" for k in keys])
    spread = figures.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
    spread = spread.withColumnsRenamed({k: f"__f_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [salted[k].eqNullSafe(spread[f"__f_{k}"]) for k in keys])
    on = on & (salted["__salt"] == spread["__salt"])
    out = salted.join(spread, on, how).drop(salted["__salt"]).drop(spread["__salt"])
    out = out.drop(*[f"__f_{k}" for k in keys])
    return out if keep_size else out.drop(size)


def attach_size(df: DataFrame, keys: Sequence[str], size: str = "n") -> DataFrame:
    """Rows with the number of rows of their key."""
    return attach(df, df.groupBy(*keys).agg(F.count(F.lit(1)).alias(size)), keys, size)
