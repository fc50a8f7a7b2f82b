"""Packed cells to rows, wide to long, long to wide, repeated blocks, row unions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import rename_matching
from .ordered import ordered_scan


def unpack(df: DataFrame, names: Sequence[str], separator: str = "\n", mismatch: str | None = None) -> DataFrame:
    """Split packed columns in parallel, one row per value.

    A cell with one value is repeated against longer ones. Other unequal lengths are padded with
    NULL and, with ``mismatch``, marked in that column.
    """
    parts = {n: F.coalesce(F.split(F.col(n), separator), F.array(F.lit(None).cast("string"))) for n in names}
    sizes = [F.size(p) for p in parts.values()]
    longest = F.greatest(*sizes) if len(sizes) > 1 else sizes[0]
    aligned = [F.when(F.size(p) == 1, F.array_repeat(F.element_at(p, 1), longest)).otherwise(p).alias(n)
               for n, p in parts.items()]
    rest = [c for c in df.columns if c not in parts]
    uneven = reduce(lambda a, b: a | b, [(s != 1) & (s != longest) for s in sizes])
    extra = [uneven.alias(mismatch)] if mismatch else []
    zipped = df.select(*rest, *extra, F.explode(F.arrays_zip(*aligned)).alias("__row"))
    picked = {c: F.col(c) for c in rest} | {n: F.col(f"__row.{n}").alias(n) for n in names}
    return zipped.select(*[picked[c] for c in df.columns], *([mismatch] if mismatch else []))


def to_long(df: DataFrame, ids: Sequence[str], names: Sequence[str], key: str = "variable",
            value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(names), key, value)


def to_wide(df: DataFrame, ids: Sequence[str], key: str, value: str, levels: Sequence,
            fill=None) -> DataFrame:
    """One column per level, in one aggregate. Two rows for one cell are an error, as there is no
    rule to choose."""
    cells = {str(v): (F.max(F.when(F.col(key) == v, F.col(value))), F.count_if(F.col(key) == v)) for v in levels}
    wide = df.groupBy(*ids).agg(*[c.alias(f"__v{i}") for i, (c, _) in enumerate(cells.values())],
                                *[n.alias(f"__n{i}") for i, (_, n) in enumerate(cells.values())])
    checked = [F.when(F.col(f"__n{i}") > 1, F.raise_error(F.lit(f"duplicate cell for {key} {name}"))).otherwise(
        F.col(f"__v{i}")).alias(name) for i, name in enumerate(cells)]
    out = wide.select(*ids, *checked)
    return out if fill is None else out.na.fill(fill, subset=list(cells))


def to_indicators(df: DataFrame, ids: Sequence[str], key: str, levels: Sequence, prefix: str = "") -> DataFrame:
    """One 0/1 column per level; a row without any listed level keeps zeros."""
    flags = [F.max(F.when(F.col(key) == v, 1).otherwise(0)).alias(f"{prefix}{v}") for v in levels]
    return df.groupBy(*ids).agg(*flags)


def indicator_columns(df: DataFrame, key: str, levels: Sequence, prefix: str = "") -> DataFrame:
    """Row-wise 0/1 columns for the levels of one column; no shuffle."""
    return df.withColumns({f"{prefix}{v}": F.coalesce((F.col(key) == v).cast("int"), F.lit(0)) for v in levels})


def stack_blocks(df: DataFrame, starts: Sequence[str], rules: Sequence[Sequence[tuple[str, str]]],
                 wave: str = "ordinal") -> DataFrame:
    """Repeated column blocks to rows with a wave number.

    Block i runs from column ``starts[i]`` to the next start; ``rules[i]`` turns its names into the
    common ones. Rows that are missing in the whole block are dropped.
    """
    places = [df.columns.index(s) for s in starts] + [len(df.columns)]
    waves = []
    for i, rule in enumerate(rules):
        block = df.select(*[F.col(f"`{c}`") for c in df.columns[places[i]:places[i + 1]]]).na.drop("all")
        waves.append(rename_matching(block, *rule).withColumn(wave, F.lit(i + 1)))
    return stack(*waves)


def stack(*frames: DataFrame) -> DataFrame:
    """Row union by name; a column missing in one frame is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def presence_rows(calls: DataFrame, subject: str, outcome: str, coordinate: str, variant: str,
                  normal: str = "normal") -> DataFrame:
    """Presence matrix in long form: one row per subject and coordinate with 0/1.

    Several calls for one cell count as present when any of them is.
    """
    return calls.groupBy(subject, outcome, coordinate).agg(
        F.max(F.when(F.col(variant) == normal, 0).otherwise(1)).alias("present"))


def burden(presence: DataFrame, subject: str, outcome: str, name: str = "n_variant") -> DataFrame:
    """Variants per subject, zeros kept."""
    return presence.groupBy(subject, outcome).agg(F.sum("present").cast("bigint").alias(name))


def presence_levels(presence: DataFrame, coordinate: str) -> DataFrame:
    """The coordinates that occur, numbered from 1 in their order: ``(level, coordinate)``. A missing coordinate has no level."""
    return ordered_scan(presence.filter(F.col(coordinate).isNotNull()).select(coordinate).distinct(), [], [coordinate], row_number="level")


def presence_sparse(presence: DataFrame, subject: str, outcome: str, coordinate: str, levels: DataFrame) -> DataFrame:
    """The matrix as one row per subject: numbers of the present levels in order and their count, zeros kept.

    Nothing is listed beforehand: a coordinate that appears for the first time gets a level and is counted."""
    numbered = levels.select(F.col(coordinate).alias("__level_of"), F.col("level"), F.xxhash64(coordinate).alias("__level_key"))
    present = presence.filter(F.col("present") == 1).withColumn("__key", F.xxhash64(coordinate))
    # the computed key gives both sides an exchange of their own, so a very common coordinate can be split
    hits = present.join(numbered, (F.col("__key") == F.col("__level_key")) & (F.col(coordinate) == F.col("__level_of")))
    rows = hits.select(subject, outcome, "level").unionByName(presence.select(subject, outcome, F.lit(None).cast("bigint").alias("level")))
    return rows.groupBy(subject, outcome).agg(F.sort_array(F.collect_set("level")).alias("levels")).withColumn("n_variant", F.size("levels"))


def presence_matrix(presence: DataFrame, subject: str, outcome: str, coordinate: str, levels: Sequence,
                    prefix: str = "coordinate_", missing: int | None = 0) -> DataFrame:
    """Display form: one 0/1 column per listed coordinate, plus the burden over all coordinates, listed or not
    (``presence_sparse`` needs no list). With ``missing=None`` an absent cell of a listed coordinate stays NULL and so does
    the burden of that row.
    """
    cells = [F.max(F.when(F.col(coordinate) == v, F.col("present"))) for v in levels]
    cells = [c if missing is None else F.coalesce(c, F.lit(missing)) for c in cells]
    listed = F.coalesce(F.col(coordinate).isin(list(levels)), F.lit(False))
    other = F.coalesce(F.sum(F.when(~listed, F.col("present"))), F.lit(0)).cast("int")
    wide = presence.groupBy(subject, outcome).agg(*[c.alias(f"{prefix}{v}") for c, v in zip(cells, levels)], other.alias("__other"))
    total = reduce(lambda a, b: a + b, [F.col(f"`{prefix}{v}`") for v in levels], F.col("__other"))
    return wide.withColumn("n_variant", total).drop("__other")


def row_sum(df: DataFrame, names: Sequence[str], name: str) -> DataFrame:
    """Sum across columns; missing if any is."""
    return df.withColumn(name, reduce(lambda a, b: a + b, [F.col(f"`{c}`") for c in names]))


def constant_table(spark, rows: Mapping[str, Sequence] , names: Sequence[str]) -> DataFrame:
    """Small lookup table from configuration."""
    return spark.createDataFrame([(k, *v) for k, v in rows.items()], list(names))
