"""Column selection, renaming and schema shaping. All resolve names on the driver; no job runs."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .skew import own_exchange


def choose(df: DataFrame, *items: str | int | slice) -> DataFrame:
    """Columns by name, 1-based position, or 1-based inclusive slice (also between two names)."""
    names: list[str] = []
    place = {c: i + 1 for i, c in enumerate(df.columns)}
    where = lambda x, default: default if x is None else place[x] if isinstance(x, str) else x
    for item in items:
        if isinstance(item, slice):
            names += df.columns[where(item.start, 1) - 1: where(item.stop, len(df.columns))]
        else:
            names.append(df.columns[item - 1] if isinstance(item, int) else item)
    return df.select(*[F.col(f"`{n}`") for n in dict.fromkeys(names)])


def choose_where(df: DataFrame, keep: Callable[[str], bool]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in df.columns if keep(c)])


def starts_with(*prefixes: str) -> Callable[[str], bool]:
    return lambda c: c.startswith(prefixes)


def ends_with(*suffixes: str) -> Callable[[str], bool]:
    return lambda c: c.endswith(suffixes)


def one_of(names: Iterable[str]) -> Callable[[str], bool]:
    known = set(names)
    return lambda c: c in known


def all_but(test: Callable[[str], bool]) -> Callable[[str], bool]:
    return lambda c: not test(c)


def rename(df: DataFrame, names: Mapping[str | int, str]) -> DataFrame:
    """Rename by old name or 1-based position."""
    chosen = {df.columns[k - 1] if isinstance(k, int) else k: v for k, v in names.items()}
    return df.withColumnsRenamed(chosen)


def rename_matching(df: DataFrame, *rules: tuple[str, str]) -> DataFrame:
    """Apply regular-expression rules, first match of each, to every column name in turn."""
    def new(name: str) -> str:
        for pattern, replacement in rules:
            name = re.sub(pattern, replacement, name, count=1)
        return name
    return df.toDF(*[new(c) for c in df.columns])


def move(df: DataFrame, names: Sequence[str], before: str | None = None, after: str | None = None) -> DataFrame:
    """Move columns next to an anchor, or to the front without one."""
    rest = [c for c in df.columns if c not in names]
    at = rest.index(before) if before else rest.index(after) + 1 if after else 0
    return df.select(*[F.col(f"`{c}`") for c in rest[:at] + list(names) + rest[at:]])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the template's columns, order and types: missing ones NULL, extras dropped."""
    out = []
    for field in schema.fields:
        c = F.col(f"`{field.name}`").try_cast(field.dataType) if field.name in df.columns else \
            F.lit(None).cast(field.dataType)
        out.append(c.alias(field.name))
    return df.select(*out)


def cast_all(df: DataFrame, to: str, names: Sequence[str] | None = None) -> DataFrame:
    return df.withColumns({c: F.col(f"`{c}`").try_cast(to) for c in (names or df.columns)})


def add(df: DataFrame, **columns: Column) -> DataFrame:
    return df.withColumns(columns)


def drop(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.drop(*names)


def product(df: DataFrame, first: str, second: str, name: str) -> DataFrame:
    """Interaction column of two named columns."""
    return df.withColumn(name, F.col(first) * F.col(second))


def name_union(*frames: DataFrame) -> list[str]:
    """Column names of all frames in first-seen order."""
    return list(dict.fromkeys(c for f in frames for c in f.columns))


def drop_rare_columns(df: DataFrame, features: Sequence[str], threshold: int, keep_at: bool = False) -> DataFrame:
    """Drop 0/1 columns whose sum is at most ``threshold`` (below it with ``keep_at``).

    One aggregate pass; its one-row result decides which columns stay.
    """
    sums = df.agg(*[F.coalesce(F.sum(f"`{c}`"), F.lit(0)).alias(c) for c in features]).first()
    rare = [c for c in features if (sums[c] < threshold if keep_at else sums[c] <= threshold)]
    return df.drop(*rare)


def drop_rare_features(long: DataFrame, feature: str, threshold: int, value: str | None = None,
                       keep_at: bool = False) -> DataFrame:
    """Long form of ``drop_rare_columns``: counts combine before the shuffle, then a semi join."""
    total = F.sum(value) if value else F.count(F.lit(1))
    support = long.groupBy(feature).agg(total.alias("__n"))
    kept = support.filter(F.col("__n") >= threshold if keep_at else F.col("__n") > threshold)
    return own_exchange(long, kept, [(feature, feature)], "left_semi")
