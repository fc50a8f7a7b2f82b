"""Ordered work inside groups: row numbers, ranks, lags, running sums and exact quantiles.

A window function reads one group in one task. ``ordered_scan`` uses plain windows as long as every
group is below the row limit; the groups above it are range-partitioned by (group, order), scanned
piece by piece, and the pieces are joined with what came before them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.missing import sort_keys
from ..session import group_rows, materialise


def _name(o: str) -> str:
    return o.lstrip("-")


def _plain(df, by, order, row_number, dense_rank, dense_on, lag, running, total) -> DataFrame:
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    w = part.orderBy(*sort_keys(order))
    out: dict[str, Column] = {}
    if row_number:
        out[row_number] = F.row_number().over(w).cast("bigint")
    if dense_rank:
        out[dense_rank] = F.dense_rank().over(part.orderBy(*sort_keys(dense_on))).cast("bigint")
    for name, c in lag.items():
        out[name] = F.lag(c).over(w)
    for name, c in running.items():
        out[name] = F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0))
    for name, c in total.items():
        out[name] = F.sum(c).over(part)
    return df.withColumns(out)


def _in_pieces(df, by, order, rows, limit, row_number, dense_rank, dense_on, lag, running, total):
    pieces = 2 * (rows // limit + 1)
    ranged = df.repartitionByRange(pieces, *[F.col(b).asc() for b in by], *sort_keys(order))
    ranged = materialise(ranged.withColumn("__piece", F.spark_partition_id()))

    w = Window.partitionBy("__piece", *by).orderBy(*sort_keys(order))
    dense_on = dense_on or order
    rank_key = F.struct(*[F.col(_name(o)) for o in dense_on])
    sums = {**running, **{f"__t_{k}": c for k, c in total.items()}}
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns({
        "__rn": F.row_number().over(w).cast("bigint"),
        "__dr": F.dense_rank().over(
            Window.partitionBy("__piece", *by).orderBy(*sort_keys(dense_on))).cast("bigint"),
        "__first_key": F.first(rank_key).over(so_far),
        "__end": F.lead(F.lit(1)).over(w).isNull(),
        **{f"__lag_{n}": F.lag(c).over(w) for n, c in lag.items()},
        **{f"__sum_{n}": F.sum(c).over(so_far) for n, c in sums.items()},
    })
    # one row per group and piece: at most (groups above the limit) + (pieces) rows
    ends = local.filter("__end").select(
        *by, "__piece", F.col("__rn").alias("__n"), F.col("__dr").alias("__d"), "__first_key",
        rank_key.alias("__last_key"),
        F.struct(F.lit(True).alias("__there"), *[F.col(c).alias(n) for n, c in lag.items()]).alias("__last"),
        *[F.col(f"__sum_{n}").alias(f"__s_{n}") for n in sums])
    chain = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("__piece")
    before = chain.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    joined_up = F.coalesce(F.lag("__last_key").over(chain).eqNullSafe(F.col("__first_key")), F.lit(False))
    joined_up = joined_up & F.lag(F.lit(1)).over(chain).isNotNull()
    carry = ends.withColumn("__tie", joined_up.cast("bigint")).select(
        *[F.col(b).alias(f"__c_{b}") for b in by], F.col("__piece").alias("__c_piece"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__b_n"),
        (F.coalesce(F.sum("__d").over(before), F.lit(0))
         - F.sum("__tie").over(chain.rowsBetween(Window.unboundedPreceding, 0))).alias("__b_d"),
        F.lag("__last").over(chain).alias("__b_last"),
        *[F.sum(f"__s_{n}").over(before).alias(f"__b_{n}") for n in running],
        *[F.sum(f"__s___t_{n}").over(whole).alias(f"__w_{n}") for n in total])
    on = local["__piece"] == carry["__c_piece"]
    for b in by:
        on = on & local[b].eqNullSafe(carry[f"__c_{b}"])
    # the broadcast side has the bound stated at ``ends``
    wide = local.join(F.broadcast(carry), on, "left")
    out = [F.col(c) for c in df.columns]
    if row_number:
        out.append((F.col("__rn") + F.col("__b_n")).alias(row_number))
    if dense_rank:
        out.append((F.col("__dr") + F.col("__b_d")).alias(dense_rank))
    for n in lag:
        out.append(F.when(F.col("__rn") == 1, F.col(f"__b_last.{n}")).otherwise(F.col(f"__lag_{n}")).alias(n))
    for n in running:
        # a sum is missing only while every value so far is
        here, earlier = F.col(f"__sum_{n}"), F.col(f"__b_{n}")
        out.append(F.when(here.isNull(), earlier).when(earlier.isNull(), here).otherwise(here + earlier).alias(n))
    for n in total:
        out.append(F.col(f"__w_{n}").alias(n))
    return wide.select(*out)


def ordered_scan(df: DataFrame, by: Sequence[str], order: Sequence[str], *, row_number: str | None = None,
                 dense_rank: str | None = None, dense_on: Sequence[str] | None = None,
                 lag: Mapping[str, str] | None = None, running: Mapping[str, str] | None = None,
                 total: Mapping[str, str] | None = None, bounded: bool = False) -> DataFrame:
    """Add ordered columns per group.

    ``order``: column names, ``-name`` for descending; missing values last. Give it a tie-break
    column, because rows have no order of their own. ``lag``/``running``/``total`` map new column to
    source column. ``bounded=True`` states that no group can exceed the row limit (for example after
    a limit on its size) and skips the measuring pass.
    """
    by, order = list(by), list(order)
    args = (row_number, dense_rank, list(dense_on or order), dict(lag or {}), dict(running or {}),
            dict(total or {}))
    if bounded:
        return _plain(df, by, order, *args)
    limit = group_rows(df.sparkSession)
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__size")).filter(F.col("__size") > limit)
    groups, rows = sizes.agg(F.count(F.lit(1)), F.sum("__size")).first()
    if not groups:
        return _plain(df, by, order, *args)
    if not by:
        return _in_pieces(df, by, order, rows, limit, *args)
    # at most rows / limit keys, so this list has a bound and can be broadcast
    hot = materialise(sizes.select(*[F.col(b).alias(f"__h_{b}") for b in by]))
    on = F.lit(True)
    for b in by:
        on = on & df[b].eqNullSafe(hot[f"__h_{b}"])
    small = df.join(F.broadcast(hot), on, "left_anti")
    large = df.join(F.broadcast(hot), on, "left_semi")
    return _plain(small, by, order, *args).unionByName(
        _in_pieces(large, by, order, rows, limit, *args))


def frequencies(df: DataFrame, by: Sequence[str], value: str, weight: str | None = None,
                n: str = "n") -> DataFrame:
    """Distinct values per group with their counts: combined before the shuffle, so a hot group
    shrinks to its distinct values."""
    count = F.sum(weight) if weight else F.count(F.lit(1))
    return df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(count.cast("bigint").alias(n))


def quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float],
              weight: str | None = None, ready: bool = False) -> DataFrame:
    """Exact quantiles (linear interpolation at ``(n - 1) p``) per group: one row per group.

    Works on the frequency table, so no task ever holds the values of a whole group. The table is
    written to the checkpoint folder once, because it is read twice (measured, then scanned);
    ``ready=True`` states that ``df`` already is such a table with its counts in ``weight``.
    """
    if ready:
        freq = df.withColumnRenamed(weight, "__n") if weight != "__n" else df
    else:
        freq = materialise(frequencies(df, by, value, weight, "__n"))
    scan = ordered_scan(freq, by, [value], running={"__cum": "__n"}, total={"__total": "__n"})
    marks = []
    for name, p in probs.items():
        position = (F.col("__total") - 1) * F.lit(float(p))
        marks += [F.min(F.when(F.col("__cum") > F.floor(position), F.col(value))).alias(f"__lo_{name}"),
                  F.min(F.when(F.col("__cum") > F.ceil(position), F.col(value))).alias(f"__hi_{name}"),
                  F.max(position - F.floor(position)).alias(f"__at_{name}")]
    picked = scan.groupBy(*by).agg(F.max("__total").alias("n"), *marks)
    return picked.select(*by, "n", *[
        (F.col(f"__lo_{k}") + (F.col(f"__hi_{k}") - F.col(f"__lo_{k}")) * F.col(f"__at_{k}")).alias(k)
        for k in probs])
