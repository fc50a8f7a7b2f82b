"""Logistic regression with interaction, risk-flag shares, and the two-equation path model."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..functions.tails import normal_two_sided
from ..session import group_rows, materialise
from .columns import product
from .joins import anti_join, semi_join
from .reshape import stack
from .skew import attach
from .summaries import shares


#: A column counts as aliased if what earlier columns leave of its square is below this share of it.
ALIASED = 1e-12
#: Newton steps at most; a fit that needs more has no finite solution.
STEPS = 25
#: Linear predictor beyond which a fitted probability counts as 0 or 1.
FAR = 23.0
ONE_KEY = "__one"
TERMS = 4
_CROSS = [(i, j) for i in range(TERMS) for j in range(i, TERMS)]


def kept_columns(cross: np.ndarray, tolerance: float = ALIASED) -> list[int]:
    """Columns that are no linear combination of earlier ones, from their cross products: Cholesky that passes over a column whose pivot
    vanishes."""
    n = len(cross)
    factor, kept = np.zeros((n, n)), []
    for j in range(n):
        row = np.zeros(n)
        for k in kept:
            row[k] = (cross[j, k] - row @ factor[k]) / factor[k, k]
        pivot = cross[j, j] - row @ row
        if cross[j, j] > 0 and pivot > tolerance * cross[j, j]:
            row[j] = np.sqrt(pivot)
            factor[j] = row
            kept.append(j)
    return kept


def _newton_step(sums: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The next state of every fit from its sums at the present coefficients."""
    def step(r):
        cross = np.zeros((TERMS, TERMS))
        for i, j in _CROSS:
            cross[i, j] = cross[j, i] = r[f"h{i}_{j}"]
        gradient = np.array([r[f"g{i}"] for i in range(TERMS)])
        beta, before = np.array(r["beta"]), np.array(r["before"])
        kept = list(r["kept"]) if r["steps"] else kept_columns(cross)
        out = {"kept": kept, "steps": r["steps"] + 1, "deviance": r["now"], "far": r["most"], "before": beta, "variance": [None] * TERMS, "done": False}
        if r["steps"] and r["now"] > r["deviance"] * (1 + 1e-12) + 1e-12 and np.abs(beta - before).max() > 1e-12:
            # too long a step: half of it
            return out | {"beta": (beta + before) / 2, "before": before, "deviance": r["deviance"], "done": r["steps"] >= STEPS}
        scale = np.sqrt(np.maximum(np.diag(cross)[kept], 1e-300))
        try:
            inverse = np.linalg.inv(cross[np.ix_(kept, kept)] / np.outer(scale, scale)) / np.outer(scale, scale)
        except np.linalg.LinAlgError:  # the weights vanished: all fitted probabilities are 0 or 1
            return out | {"beta": beta, "done": True, "far": np.inf}
        for k, v in zip(kept, np.diag(inverse)):
            out["variance"][k] = float(v) if np.isfinite(v) and v > 0 else None
        near = r["steps"] > 0 and abs(r["deviance"] - r["now"]) <= 1e-12 * (r["now"] + 0.1)
        if near or r["steps"] >= STEPS:
            return out | {"beta": beta, "done": True}
        further = beta.copy()
        further[kept] += inverse @ gradient[kept]
        return out | {"beta": further}
    for part in sums:
        new = pd.DataFrame([step(r) for r in part.to_dict("records")], columns=["kept", "steps", "deviance", "far", "before", "variance", "done", "beta"])
        keys = part[[c for c in part.columns if c.startswith("__k")] + ["cells"]].reset_index(drop=True)
        yield pd.concat([keys, new], axis=1)


def logit_interaction(df: DataFrame, outcome: str, first: str, second: str, by: Sequence[str] = ()) -> DataFrame:
    """Binomial regression ``outcome ~ first * second``, one fit for each key: a row per key and term.

    Rows are reduced to distinct (key, predictors) with their numbers first. Newton steps then run over that table, all keys at once: a
    step is one aggregate of sums of each key and a small solve per key; keys that have converged drop out. A large key is
    spread over tasks. ``deviance``, ``null_deviance``, ``aic`` and ``n`` repeat on every row of a key.

    A term that is constant or a linear combination of earlier ones has NULL figures and takes no part. ``note`` tells where fitted
    probabilities are 0 or 1 (separated outcomes: estimates grow without end). Keys without complete rows, and empty inputs, give no rows.
    """
    keys, names = list(by) or [ONE_KEY], ["(Intercept)", first, second, f"{first}:{second}"]
    held = [f"__k{i}" for i in range(len(keys))]
    source = df if by else df.withColumn(ONE_KEY, F.lit(0))
    rows = source.select(*[F.col(f"`{k}`").alias(h) for k, h in zip(keys, held)], *[F.col(f"`{c}`").cast("double").alias(n) for c, n in zip((outcome, first, second), ("y", "a", "b"))]).na.drop(subset=["y", "a", "b"])
    cells = materialise(rows.groupBy(*held, "a", "b").agg(F.count(F.lit(1)).cast("double").alias("w"), F.sum("y").alias("ones")))
    totals = materialise(cells.groupBy(*held).agg(F.count(F.lit(1)).alias("cells"), F.sum("w").alias("n"), F.sum("ones").alias("ones")))
    # cells of a large key are dealt to several salts, which each get its coefficients
    salts = F.ceil(F.col("cells") / group_rows(df.sparkSession)).cast("int")
    if totals.filter(salts > 1).isEmpty():
        cells = cells.withColumn("salt", F.lit(0))
    else:
        sized = attach(cells, totals.select(*held, "cells"), held, "cells")
        cells = materialise(sized.withColumn("salt", F.pmod(F.xxhash64("a", "b"), salts).cast("int")).drop("cells"))
    zero = F.array(*[F.lit(0.0)] * TERMS)
    state = totals.select(*held, "cells", F.array().cast("array<int>").alias("kept"), F.lit(0).alias("steps"), F.lit(0.0).alias("deviance"), F.lit(0.0).alias("far"),
                          zero.alias("before"), F.array(*[F.lit(None).cast("double")] * TERMS).alias("variance"), F.lit(False).alias("done"), zero.alias("beta"))
    schema = state.schema
    x = [F.lit(1.0), F.col("a"), F.col("b"), F.col("a") * F.col("b")]
    finished = None
    while not state.isEmpty():
        spread = state.select(*[F.col(h).alias(f"__s{i}") for i, h in enumerate(held)], "beta", F.explode(F.sequence(F.lit(0), salts - 1)).alias("__salt"))
        same = reduce(lambda p, q: p & q, [F.col(h).eqNullSafe(F.col(f"__s{i}")) for i, h in enumerate(held)])
        met = cells.join(spread, same & (F.col("salt") == F.col("__salt")))
        eta = sum((F.col("beta")[i] * x[i] for i in range(1, TERMS)), F.col("beta")[0])
        met = met.withColumn("eta", eta).withColumn("p", 1 / (1 + F.exp(-F.col("eta"))))
        # - 2 log likelihood without losing the tails
        log_p, log_q = -F.log1p(F.exp(-F.abs("eta"))) + F.least(F.col("eta"), F.lit(0.0)), -F.log1p(F.exp(-F.abs("eta"))) - F.greatest(F.col("eta"), F.lit(0.0))
        weight, residual = F.col("w") * F.col("p") * (1 - F.col("p")), F.col("ones") - F.col("w") * F.col("p")
        sums = met.groupBy(*held).agg(*[F.sum(weight * x[i] * x[j]).alias(f"h{i}_{j}") for i, j in _CROSS], *[F.sum(residual * x[i]).alias(f"g{i}") for i in range(TERMS)],
                                      F.sum(-2 * (F.col("ones") * log_p + (F.col("w") - F.col("ones")) * log_q)).alias("now"), F.max(F.abs("eta")).alias("most"))
        sums = sums.withColumnsRenamed({h: f"__s{i}" for i, h in enumerate(held)})
        same = reduce(lambda p, q: p & q, [F.col(h).eqNullSafe(F.col(f"__s{i}")) for i, h in enumerate(held)])
        state = materialise(state.join(sums, same).drop(*[f"__s{i}" for i in range(len(held))]).mapInPandas(_newton_step, schema))
        ready = state.filter("done")
        finished = ready if finished is None else finished.unionByName(ready)
        state = state.filter(~F.col("done"))
    out = (state if finished is None else finished).withColumnsRenamed({h: f"__f{i}" for i, h in enumerate(held)})
    same = reduce(lambda p, q: p & q, [F.col(h).eqNullSafe(F.col(f"__f{i}")) for i, h in enumerate(held)])
    out = out.join(totals.drop("cells"), same)
    share = F.col("ones") / F.col("n")
    null = -2 * (F.when(share > 0, F.col("ones") * F.log(share)).otherwise(0.0) + F.when(share < 1, (F.col("n") - F.col("ones")) * F.log(1 - share)).otherwise(0.0))
    term = F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.when(F.array_contains("kept", i), F.col("beta")[i]).alias("estimate"),
                                        F.when(F.array_contains("kept", i), F.sqrt(F.col("variance")[i])).alias("std_error")) for i, t in enumerate(names)])).alias("t")
    note = F.when((F.col("far") > FAR) | (F.col("steps") > STEPS), F.lit("fitted probabilities of 0 or 1"))
    out = out.select(*([F.col(h).alias(k) for h, k in zip(held, keys)] if by else []), term, "deviance", null.alias("null_deviance"), (F.col("deviance") + 2 * F.size("kept")).alias("aic"), F.col("n").cast("bigint").alias("n"), note.alias("note"))
    out = out.select(*by, "t.*", F.try_divide("t.estimate", "t.std_error").alias("z"), "deviance", "null_deviance", "aic", "n", "note")
    return out.withColumn("p_value", normal_two_sided("z"))


def risk_flag_shares(df: DataFrame, outcome: str, first: str, second: str) -> DataFrame:
    """Counts and shares of interaction and outcome among rows where each risk flag is set:
    ``(flag, target, level, n, proportion)``, one pass."""
    kept = product(df.select(first, second, outcome), first, second, "interaction").na.drop()
    targets = ("interaction", outcome)
    rows = [F.struct(F.lit(flag).alias("flag"), F.col(flag).cast("int").alias("set"), F.lit(t).alias("target"),
                     F.col(t).cast("int").alias("level"))
            for flag in (first, second, "interaction") for t in targets]
    long = kept.select(F.explode(F.array(*rows)).alias("r")).select("r.*").filter(F.col("set") == 1)
    return shares(long, ["flag", "target", "level"], ["flag", "target"])


def sweep(m: np.ndarray, k: int) -> None:
    """Sweep a symmetric matrix on its k-th diagonal element, in place."""
    pivot = m[k, k]
    row = m[k] / pivot
    m -= np.outer(m[:, k], row)
    m[k] = row
    m[:, k] = row
    m[k, k] = -1 / pivot


def _equations(names: Sequence[str], equations: Mapping[str, Sequence[str]], keys: int):
    """Edges of every key from its covariances (one row for each key)."""
    place, pairs = {v: i for i, v in enumerate(names)}, [(i, j) for i in range(len(names)) for j in range(i, len(names))]

    def edges(n, cov):
        for y, xs in equations.items():
            work, yi, kept = cov.copy(), place[y], []
            for x in xs:
                i = place[x]
                # what the predictors before it leave of its variance
                if i not in kept and cov[i, i] > 0 and work[i, i] > ALIASED * cov[i, i]:
                    sweep(work, i)
                    kept.append(i)
            residual = max(work[yi, yi], 0.0)
            spread = cov[yi, yi]
            done = set()
            for x in xs:
                i = place[x]
                if i not in kept or i in done:
                    yield y, "~", x, None, None, None, None
                    continue
                done.add(i)
                b, se = work[i, yi], np.sqrt(residual * -work[i, i] / n)
                yield y, "~", x, float(b), float(se), float(b / se) if se > 0 else None, float(b * np.sqrt(cov[i, i] / spread)) if spread > 0 else None
            wide = residual * np.sqrt(2 / n)
            yield y, "~~", y, float(residual), float(wide), float(residual / wide) if wide > 0 else None, float(residual / spread) if spread > 0 else None

    def work(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            held = part.iloc[:, :keys].reset_index(drop=True)
            at, out = [], []
            for k, r in enumerate(part.to_dict("records")):
                cov = np.zeros((len(names), len(names)))
                for i, j in pairs:
                    cov[i, j] = cov[j, i] = r[f"c{i}_{j}"]
                new = list(edges(r["n"], cov))
                out += new
                at += [k] * len(new)
            found = pd.DataFrame(out, columns=["lhs", "op", "rhs", "est", "se", "z", "std"])
            yield pd.concat([held.iloc[at].reset_index(drop=True), found], axis=1)
    return work


def path_model(df: DataFrame, equations: Mapping[str, Sequence[str]], by: Sequence[str] = ()) -> DataFrame:
    """Recursive path model, one for each key: per-equation least squares from one pass of covariances.

    Complete cases only. Edges ``(by…, lhs, op, rhs, est, se, z, std, p_value)``; ``~~`` rows hold the residual variances. The cross products
    of a key are one row; each equation sweeps them on its predictors, in order. A constant predictor, or one that earlier predictors
    of the equation determine, has NULL figures and takes no part. Keys without complete rows, and empty inputs, give no rows.
    """
    names = list(dict.fromkeys(v for y, xs in equations.items() for v in (y, *xs)))
    by = list(by)
    data = df.select(*[F.col(f"`{k}`") for k in by], *[F.col(f"`{v}`").cast("double").alias(f"__v{i}") for i, v in enumerate(names)]).na.drop(subset=[f"__v{i}" for i in range(len(names))])
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = data.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.covar_pop(f"__v{i}", f"__v{j}").alias(f"c{i}_{j}") for i, j in pairs]).filter("n > 0")
    schema = StructType([*[sums.schema[k] for k in by], *[StructField(c, StringType()) for c in ("lhs", "op", "rhs")], *[StructField(c, DoubleType()) for c in ("est", "se", "z", "std")]])
    return sums.mapInPandas(_equations(names, equations, len(by)), schema).withColumn("p_value", normal_two_sided("z"))


def prune_edges(edges: DataFrame, level: float = 0.05, least: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Edges that are significant in either direction (variances always stay) with weak standardised
    values set to 0, and the edges that were dropped."""
    variance = (F.col("op") == "~~") | (F.col("lhs") == F.col("rhs"))
    check, keep = edges.filter(~variance), edges.filter(variance)
    strong = edges.filter((F.col("p_value") < level) & (F.col("lhs") != F.col("rhs"))).select("lhs", "rhs")
    same = semi_join(check, strong, [("lhs", "lhs"), ("rhs", "rhs")])
    crossed = semi_join(check, strong, [("lhs", "rhs"), ("rhs", "lhs")])
    kept = stack(keep, same, crossed)
    dropped = anti_join(edges, kept, ["lhs", "op", "rhs"])
    return kept.withColumn("std", F.when(F.abs("std") < least, 0.0).otherwise(F.col("std"))), dropped


def prepare_path_cohort(raw: DataFrame, names: Sequence[str], numbers: Sequence[str], flags: Sequence[str],
                        codes: Mapping[str, str], treatments: Mapping[str, str]) -> DataFrame:
    """Positional all-text cohort to model columns: first column dropped, numbers cast, 0/1 flags,
    ``codes`` new flag ← code column (false where ``#N/A``), ``treatments`` (false where ``#N/A`` or 0)."""
    df = raw.select(*[F.col(f"`{c}`") for c in raw.columns[1:]]).toDF(*names)
    out = {c: F.col(c).try_cast("double") for c in numbers}
    out |= {c: F.when(F.col(c) == "0", False).when(F.col(c) == "1", True) for c in flags}
    out |= {new: F.col(c) != "#N/A" for new, c in codes.items()}
    out |= {new: ~F.coalesce(F.col(c).isin("#N/A", "0"), F.lit(False)) for new, c in treatments.items()}
    return df.withColumns(out)

