"""Classifiers on one seeded split, scored by the same metrics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise
from .ordered import ordered_scan
from .ordering import top
from .sampling import split
from .skew import attach, own_exchange

BLOCK_ROWS = 20_000
CHUNK_ROWS = 256
FOREST_ROWS = 200_000  # from here on a forest may be grown on counted vectors
FITS = 8  # trees that are fitted side by side
BLOCK_VALUES = 20_000_000  # numbers per block: wide vectors get fewer rows


def assemble(df: DataFrame, features: Sequence[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=name).transform(df)


def item_features(item_rows: DataFrame, subjects: DataFrame, subject: str, item: str = "item_set",
                  threshold: int = 0) -> tuple[DataFrame, list[str]]:
    """Sparse 0/1 vectors from long item rows, and the sorted ``items`` behind them; items with support at most ``threshold``
    are left out."""
    pairs = item_rows.select(subject, F.col(item).alias("__item")).distinct()
    pairs = pairs.join(subjects.select(F.col(subject).alias("__s")), F.col(subject) == F.col("__s"), "left_semi")
    support = pairs.groupBy("__item").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > threshold)
    bags = own_exchange(pairs, support, [("__item", "__item")], "left_semi").groupBy(subject).agg(
        F.sort_array(F.collect_set("__item")).alias("items"))
    rows = subjects.join(bags, subject, "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    rows = materialise(rows)  # read by the fit and by the result
    # the vocabulary holds every supported item: their number is counted, nothing is cut off
    model: CountVectorizerModel = CountVectorizer(inputCol="items", outputCol="features", binary=True, minDF=1.0,
                                                  vocabSize=max(1, support.count())).fit(rows)
    return model.transform(rows), list(model.vocabulary)


def _predict(model: Model, rows: DataFrame, keep: Sequence[str], name: str) -> DataFrame:
    return model.transform(rows).select(
        *keep, F.lit(name).alias("model"), F.col("prediction").cast("int").alias("prediction"),
        vector_to_array("probability")[1].alias("score"))


def counted_vectors(rows: DataFrame, label: str, features: str = "features", name: str = "__rows") -> DataFrame:
    """Different vectors with their label and number of rows: what a learner that weighs rows needs of them."""
    return materialise(rows.groupBy(features, label).agg(F.count(F.lit(1)).cast("double").alias(name)))


def logistic(train: DataFrame, label: str, c: float = 1.0, features: str = "features", weight: str | None = None):
    """L2 penalty with inverse strength ``c`` on unscaled features, intercept free. ``weight`` holds the number of equal rows."""
    n = train.agg(F.sum(weight)).first()[0] if weight else train.count()
    weights = {"weightCol": weight} if weight else {}
    return LogisticRegression(labelCol=label, featuresCol=features, regParam=1.0 / (c * n), elasticNetParam=0.0,
                              standardization=False, maxIter=100, tol=1e-8, **weights).fit(train)


def forest(train: DataFrame, label: str, trees: int = 100, seed: int = 28, features: str = "features"):
    return RandomForestClassifier(labelCol=label, featuresCol=features, numTrees=trees, maxDepth=30, seed=seed,
                                  featureSubsetStrategy="sqrt").fit(train)


def _drawn(counted: DataFrame, label: str, trees: int, seed: int) -> DataFrame:
    """Bootstrap numbers of every vector and label, one per tree: as many rows drawn one by one with replacement as Spark's forest
    draws them (a Poisson number of mean 1 each) sum to a Poisson number whose mean is their count."""
    def draw(batches):
        for b in batches:
            draws = [np.random.default_rng([seed, int(k) & 0xFFFFFFFFFFFFFFFF]).poisson(n, trees).astype(float) for k, n in zip(b["__seed"], b["__rows"])]
            yield b[["__seed"]].assign(__draws=draws)

    keyed = materialise(counted.withColumn("__seed", F.xxhash64(F.col("features").cast("string"), F.col(label))))
    numbers = keyed.select("__seed", "__rows").mapInPandas(draw, "__seed long, __draws array<double>")
    return materialise(keyed.join(numbers.dropDuplicates(["__seed"]), "__seed"))


def forest_votes(counted: DataFrame, wanted: DataFrame, label: str, trees: int = 100, seed: int = 28) -> DataFrame:
    """What a forest of that many trees says of the different vectors ``wanted`` (``__vector``, ``features``, their number ``__rows``), grown on
    ``counted_vectors``: ``(__vector, __rows, prediction, score)``.

    A tree is fitted on the vectors weighed by how often it drew them, so the work is by vectors and not by rows."""
    drawn = _drawn(counted, label, trees, seed)
    classes = F.col(label).alias(label, metadata={"ml_attr": {"type": "nominal", "num_vals": 2}})  # a tree may draw one class only

    def tree(k: int) -> DataFrame:
        rows = drawn.select("features", classes, F.col("__draws")[k].alias("__weight")).filter("__weight > 0")
        model = RandomForestClassifier(labelCol=label, numTrees=1, maxDepth=30, seed=seed + k, bootstrap=False, weightCol="__weight",
                                       featureSubsetStrategy="sqrt").fit(rows)
        return model.transform(wanted).select("__vector", "__rows", vector_to_array("probability")[1].alias("p"))

    with ThreadPool(FITS) as pool:
        said = pool.map(inheritable_thread_target(counted.sparkSession)(tree), range(trees))
    score = F.avg("p").alias("score")
    return materialise(reduce(DataFrame.unionByName, said).groupBy("__vector", "__rows").agg(score)).withColumn(
        "prediction", (F.col("score") > 0.5).cast("int"))


def _forest_predictions(train: DataFrame, counted: DataFrame, validation: DataFrame, keep: Sequence[str], label: str, trees: int,
                        seed: int) -> DataFrame:
    """Many rows of few vectors go through ``forest_votes``; else the forest reads the rows."""
    size = counted.agg(F.count(F.lit(1)).alias("vectors"), F.sum("__rows").alias("rows")).first()
    if not size["rows"] or size["rows"] < FOREST_ROWS or size["vectors"] * trees > size["rows"]:
        return _predict(forest(train, label, trees, seed), validation, keep, "Random_Forest")
    named = validation.withColumn("__vector", F.col("features").cast("string"))
    wanted = materialise(named.groupBy("__vector").agg(F.first("features").alias("features"), F.count(F.lit(1)).alias("__rows")))
    votes = forest_votes(counted, wanted, label, trees, seed)
    out = attach(named.select(*keep, "__vector"), votes, ["__vector"], "__rows", how="inner", keep_size=False)
    return out.select(*keep, F.lit("Random_Forest").alias("model"), "prediction", "score")


def boosting(train: DataFrame, label: str, stages: int = 100, features: str = "features", weight: str | None = None):
    weights = {"weightCol": weight} if weight else {}
    return GBTClassifier(labelCol=label, featuresCol=features, maxIter=stages, maxDepth=3, stepSize=0.1, seed=28, **weights).fit(train)


def coefficients(spark: SparkSession, model, names: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, model.coefficients.toArray())],
                                 "coordinate string, coefficient double")


def importances(spark: SparkSession, model, names: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, model.featureImportances.toArray())],
                                 "coordinate string, feature_importance double")


def top_importances(table: DataFrame, n: int = 10) -> DataFrame:
    return top(table, ["-feature_importance", "coordinate"], n)


def _set_distances(queries: list, block: pd.Series) -> np.ndarray:
    """Squared distances of 0/1 vectors given as sets of items: sizes of both minus twice what they share."""
    sizes = np.array([len(b) for b in block])
    number: dict = {}
    items = np.array([number.setdefault(i, len(number)) for b in block for i in b], np.int64)
    rows = np.repeat(np.arange(len(block)), sizes)
    order = np.argsort(items, kind="stable")
    rows, ends = rows[order], np.searchsorted(items[order], np.arange(len(number) + 1))
    out = np.empty((len(queries), len(block)))
    for k, q in enumerate(queries):
        hit = [rows[ends[number[i]]:ends[number[i] + 1]] for i in q if i in number]
        shared = np.bincount(np.concatenate(hit), minlength=len(block)) if hit else 0
        out[k] = sizes + len(q) - 2 * shared
    return out


def nearest_neighbours(train: DataFrame, validation: DataFrame, subject: str, features: str, label: str, k: int = 5,
                       block_rows: int = BLOCK_ROWS, sets: bool = False) -> DataFrame:
    """k nearest training rows of every validation row (squared distance, then id): exact.

    ``features`` is an array column; with ``sets`` it holds the sorted items of a 0/1 vector, so keys and blocks stay as
    small as the rows are, however many items there are in all. Equal vectors are handled once: of training rows with the same
    vector only the k smallest ids can ever be chosen, and validation rows with the same vector share their answer.

    Both sides are cut into blocks of bounded size in the order of their length (set size, or distance from the origin), which
    bounds distances from below. Every block of validation vectors is compared with its nearest training block first; the
    k-th distances found there tell which other blocks can still hold a nearer row, and only these are opened. A pair of
    blocks is one task that hands on its k best rows per vector, so neither side is ever held whole.
    """
    return _search(train, validation, subject, features, label, k, block_rows, sets)[0]


def opened_blocks(train: DataFrame, validation: DataFrame, subject: str, features: str, label: str, k: int = 5,
                  block_rows: int = BLOCK_ROWS, sets: bool = False) -> DataFrame:
    """The work of ``nearest_neighbours``: pairs of blocks in all and those that are compared, ``(pairs, opened)``."""
    pairs = _search(train, validation, subject, features, label, k, block_rows, sets)[1]
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), F.count_if("open").alias("opened"))


def _length(sets: bool) -> Column:
    """Set size or distance from the origin of ``__x``: lengths differ by no more than what lies between two vectors."""
    if sets:
        return F.size("__x").cast("double")
    square = F.aggregate("__x", F.lit(0.0), lambda total, v: total + v * v)
    return F.coalesce(F.nanvl(F.sqrt(square), F.lit(0.0)), F.lit(0.0))  # rows with NaN are opened by the NaN in their distances


def _in_blocks(df: DataFrame, order: str, block_rows: int, name: str) -> DataFrame:
    numbered = ordered_scan(df, [], ["__length", order], row_number="__number")
    return materialise(numbered.withColumn(name, F.floor((F.col("__number") - 1) / block_rows).cast("int")).drop("__number"))


def _search(train: DataFrame, validation: DataFrame, subject: str, features: str, label: str, k: int, block_rows: int,
            sets: bool) -> tuple[DataFrame, DataFrame]:
    kind = train.schema[features].dataType.simpleString() if sets else "array<double>"
    x = F.col(features).cast(kind).alias("__x")
    id_kind = train.schema[subject].dataType.simpleString()
    same = Window.partitionBy("__x").orderBy("__id")
    known = train.select(F.col(subject).alias("__id"), x, F.col(label).cast("int").alias("__label"))
    # the window group limit keeps k rows per vector in every task, so copies shrink before the shuffle
    known = materialise(known.withColumn("__r", F.row_number().over(same)).filter(F.col("__r") <= k).drop("__r"))
    wanted = validation.select(subject, x)
    asked = materialise(wanted.groupBy("__x").agg(F.count(F.lit(1)).alias("__rows")))
    known_blocks = max(1, -(-known.count() // block_rows))
    asked_blocks = max(1, -(-asked.count() // block_rows))

    def best(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(queries) and len(block):
            block = block.sort_values("__id", kind="stable")
            b = None if sets else np.stack(block["__x"].to_numpy())
            ids, labels = block["__id"].to_numpy(), block["__label"].to_numpy()
            vectors, asked_in = queries["__x"].to_numpy(), queries["__v"].to_numpy()
            for start in range(0, len(vectors), CHUNK_ROWS):
                if sets:
                    distance = _set_distances(list(vectors[start:start + CHUNK_ROWS]), block["__x"])
                else:
                    part = np.stack(vectors[start:start + CHUNK_ROWS])
                    distance = np.zeros((len(part), len(b)))
                    for j in range(b.shape[1]):
                        distance += (part[:, j, None] - b[None, :, j]) ** 2
                order = np.argsort(distance, axis=1, kind="stable")[:, :k]
                parts.append(pd.DataFrame({
                    "__x": np.repeat(vectors[start:start + CHUNK_ROWS], order.shape[1]),
                    "__v": np.repeat(asked_in[start:start + CHUNK_ROWS], order.shape[1]),
                    "__id": ids[order].ravel(), "__label": labels[order].ravel(),
                    "__distance": np.take_along_axis(distance, order, 1).ravel()}))
        columns = ["__x", "__v", "__id", "__label", "__distance"]
        return pd.concat(parts) if parts else pd.DataFrame({c: [] for c in columns})

    def blocks(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.groupBy("__v", "__t").cogroup(right.groupBy("__v", "__t")).applyInPandas(
            best, f"__x {kind}, __v int, __id {id_kind}, __label int, __distance double")

    def compare(pairs: DataFrame) -> DataFrame:
        return blocks(asked.join(pairs.select("__v", "__t"), "__v").select("__x", "__v", "__t"),
                      known.join(pairs.select("__v", "__t"), "__t").select("__id", "__x", "__label", "__v", "__t"))

    if known_blocks == 1:  # nothing to leave out
        pairs = train.sparkSession.range(asked_blocks).select(F.col("id").cast("int").alias("__v"), F.lit(0).alias("__t"), F.lit(True).alias("open"))
        number = F.pmod(F.xxhash64("__x"), F.lit(asked_blocks)).cast("int")
        found = blocks(asked.select("__x", number.alias("__v"), F.lit(0).alias("__t")),
                       known.withColumns({"__t": F.lit(0), "__v": F.explode(F.sequence(F.lit(0), F.lit(asked_blocks - 1)))}))
    else:
        known = _in_blocks(known.withColumn("__length", _length(sets)), "__id", block_rows, "__t")
        asked = _in_blocks(asked.withColumn("__length", _length(sets)), "__x", block_rows, "__v")
        ends = lambda d, b, p: d.groupBy(b).agg(F.min("__length").alias(f"{p}_low"), F.max("__length").alias(f"{p}_high"))
        # block pairs, not rows: (rows / block_rows) on either side
        pairs = ends(asked, "__v", "v").withColumn("__t", F.explode(F.sequence(F.lit(0), F.lit(known_blocks - 1))))
        pairs = pairs.join(ends(known, "__t", "t"), "__t")
        slack = 1e-9 * F.greatest("v_high", "t_high")  # lengths are rounded
        gap = F.greatest(F.col("t_low") - F.col("v_high") - slack, F.col("v_low") - F.col("t_high") - slack, F.lit(0.0))
        middle = F.abs(F.col("t_low") + F.col("t_high") - F.col("v_low") - F.col("v_high"))
        pairs = pairs.select("__v", "__t", (gap if sets else gap * gap).alias("least"), middle.alias("middle"))
        home = pairs.groupBy("__v").agg(F.min(F.struct("least", "middle", "__t")).alias("first"))
        pairs = materialise(pairs.join(home, "__v").withColumn("home", F.col("__t") == F.col("first.__t")).drop("first", "middle"))
        near = materialise(compare(pairs.filter("home")))
        # a block is needed up to the largest k-th distance of its vectors; without k rows every block is
        reach = near.groupBy("__v", "__x").agg(F.when(F.count(F.lit(1)) == k, F.max("__distance")).otherwise(F.lit(float("inf"))).alias("kth"))
        reach = reach.groupBy("__v").agg(F.max("kth").alias("reach"))
        pairs = materialise(pairs.join(reach, "__v").select("__v", "__t", "home", (F.col("home") | (F.col("least") <= F.col("reach"))).alias("open")))
        found = near.unionByName(compare(pairs.filter("open AND NOT home")))
    # at most k rows per vector and opened block of training rows
    w = Window.partitionBy("__x").orderBy("__distance", "__id")
    nearest = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    answers = nearest.groupBy("__x").agg(F.collect_list(F.struct(
        "rank", F.col("__id").alias("neighbour"), F.col("__distance").alias("distance"),
        F.col("__label").alias("neighbour_label"))).alias("__nearest"))  # k entries
    answers = answers.join(asked.select("__x", "__rows"), "__x")
    rows = attach(wanted, answers, ["__x"], "__rows", how="inner", keep_size=False)
    return rows.select(subject, F.explode("__nearest").alias("__n")).select(subject, "__n.*"), pairs


def knn_vote(neighbours: DataFrame, subject: str) -> DataFrame:
    """Majority label and share of positive neighbours; a tie goes to the smaller label."""
    share = F.avg(F.col("neighbour_label").cast("double"))
    return neighbours.groupBy(subject).agg(share.alias("score")).withColumn(
        "prediction", (F.col("score") > 0.5).cast("int"))


def rule_any(*flags: str) -> Column:
    """1 when any flag is set."""
    from ..functions.text import any_flag
    return any_flag(*flags)


def rule_at_least(burden: str, threshold: int = 3) -> Column:
    return (F.col(burden) >= threshold).cast("int")


def compare_models(df: DataFrame, subject: str, features: Sequence[str], label: str, validation_share: float = 0.25,
                   seed: int = 28, trees: int = 100, stages: int = 100) -> DataFrame:
    """Predictions of logistic regression, random forest, k-NN and boosting on one validation split:
    ``(subject, label, model, prediction, score)``."""
    rows = assemble(df.select(subject, label, *features), features)
    return compare_on_vectors(rows, subject, label, len(features), validation_share, seed, trees, stages)


def compare_on_vectors(rows: DataFrame, subject: str, label: str, size: int, validation_share: float = 0.25,
                       seed: int = 28, trees: int = 100, stages: int = 100) -> DataFrame:
    """The same for rows that already carry a ``features`` vector of the given size, and perhaps the ``items`` of a 0/1 vector
    (see ``item_features``), which the neighbours then go by.

    Regression and boosting draw no rows, so equal training rows are one row with their number as weight: their many passes
    go over the different vectors. The forest does so too where many rows have few vectors (see ``forest_votes``)."""
    sets = "items" in rows.columns
    rows = materialise(rows.select(subject, label, "features", *["items"] * sets))  # every learner reads it several times
    train, validation = split(rows, [subject], validation_share, seed)
    keep = [subject, label]
    counted = counted_vectors(train, label)
    out = _predict(logistic(counted, label, weight="__rows"), validation, keep, "Logistic_Regression")
    out = out.unionByName(_forest_predictions(train, counted, validation, keep, label, trees, seed))
    out = out.unionByName(_predict(boosting(counted, label, stages, weight="__rows"), validation, keep, "Gradient_Boosting"))
    arrays = lambda d: d.withColumn("__a", F.col("items") if sets else vector_to_array("features"))
    block = BLOCK_ROWS if sets else max(CHUNK_ROWS, min(BLOCK_ROWS, BLOCK_VALUES // max(size, 1)))
    votes = knn_vote(nearest_neighbours(arrays(train), arrays(validation), subject, "__a", label, block_rows=block, sets=sets), subject)
    near = validation.select(*keep).join(votes, subject).select(
        *keep, F.lit("K_Neighbors").alias("model"), "prediction", "score")
    return out.unionByName(near)
