"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes, distance-weighted votes.

Terms are words and beginnings of words (4 to 6 letters, so that inflected forms meet). The vocabulary is learned: terms whose share of
the toxic examples differs from chance by an exact binomial test, at a false discovery rate of ``FALSE_SHARE`` over all terms that are
frequent enough to reach ``LEAST_P`` at all, up to ``most_terms``. No size of effect is asked for, so a word in few toxic examples and in no
other one counts. Equal texts are one example in the test. Examples are vectors (1 + log tf) * idf of length 1
over this vocabulary. Every text finds its ``NEIGHBOURS`` nearest examples exactly; the score is the vote of their labels, weighted by
the square of the cosine and by how many labelled rows an example stands for, with the share of toxic rows among the examples without
any term as prior. A text without any term of the vocabulary gets that prior. The nearest examples are returned as evidence.

Bounds on learning: at most ``sample_rows`` labelled rows of each label, chosen by a hash, also where doc_ids repeat, and at most
``most_terms`` terms; everything else covers all rows.

Defined results
* Null and empty texts get the prior. Without labelled rows every score is 0. Several labels of one doc_id: toxic if one of them is.
* Labels that are null, or of held-out rows, teach nothing. Repeated rows each give a row. Extra columns are ignored.
* Ties between examples are decided by their place in the index: label, heaviest term, hash of the text. An empty table gives no rows.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tails
from ..session import materialise
from .blockmax import BlockMax
from .common import batched, held_out, held_out_id, prepare, rows_of, share, ship, table

SAMPLE_ROWS = 6000
MOST_TERMS = 4096
#: Terms are tested if their documents could give a p-value as small as this, all of them having the rarer label.
LEAST_P = 1e-4
FALSE_SHARE = 0.01
NEIGHBOURS = 15
#: Weight of the prior among the votes.
PRIOR_WEIGHT = 4.0
CUT = 0.3
EVIDENCE = 3
REMEMBERED = 300_000

_WORD = re.compile(r"[^\W_]+")


def terms_of(word: str) -> list[str]:
    return [word, *[word[:k] + "*" for k in (4, 5, 6) if len(word) >= k]]


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class Known(dict):
    """word -> numbers of its terms in the vocabulary; forgets everything when it is full."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        found = tuple(self.vocabulary[t] for t in terms_of(word) if t in self.vocabulary)
        if len(word) <= 40:
            self[word] = found
        return found


class Neighbours:
    """Index of the labelled examples and the vote."""

    def __init__(self, vocabulary: list[str], idf: np.ndarray, examples: list[tuple[int, int, float, dict[int, int]]]):
        """examples: doc_id, label, weight (rows it stands for), counts of its terms."""
        self.vocabulary = {t: k for k, t in enumerate(vocabulary)}
        self.idf = idf
        item, term, weight = [], [], []
        with_terms = [e for e in examples if e[3]]
        for k, (_, _, _, counts) in enumerate(with_terms):
            t, w = self.vector(counts)
            item += [k] * len(t)
            term += t.tolist()
            weight += w.tolist()
        self.index = BlockMax(np.array(item, np.int64), np.array(term, np.int64), np.array(weight), len(with_terms), len(vocabulary), 32)
        self.ids = [e[0] for e in with_terms]
        self.label = np.array([e[1] for e in with_terms], float)
        self.stands = np.array([e[2] for e in with_terms])
        rest = [(e[1], e[2]) for e in examples if not e[3]] or [(e[1], e[2]) for e in examples]
        total = sum(s for _, s in rest)
        self.prior = (sum(y * s for y, s in rest) + 0.5 * bool(rest)) / (total + 50) if rest else 0.0
        self.votes: dict[bytes, tuple[float, str]] = {}

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        t = np.array(sorted(counts), np.int64)
        w = (1 + np.log(np.array([counts[k] for k in t.tolist()], float))) * self.idf[t]
        length = math.sqrt(float((w * w).sum()))
        return t, w / length if length else w

    def score(self, counts: dict[int, int]) -> tuple[float, str]:
        if not counts:
            return self.prior, ""
        t, w = self.vector(counts)
        key = t.tobytes() + w.tobytes()
        if key not in self.votes:
            if len(self.votes) >= REMEMBERED // 10:
                self.votes.clear()
            near = self.index.best(t, w, NEIGHBOURS)
            which, cosine = np.array([k for k, _ in near], np.int64), np.array([c for _, c in near])
            vote = cosine ** 2 * self.stands[which]
            p = (float((vote * self.label[which]).sum()) + PRIOR_WEIGHT * self.prior) / (float(vote.sum()) + PRIOR_WEIGHT)
            said = ",".join(f"{self.ids[k]}:{int(self.label[k])}:{c:.4f}" for k, c in near[:EVIDENCE])
            self.votes[key] = min(1.0, max(0.0, p)), said
        return self.votes[key]


def counted(known: Known, text: str | None) -> dict[int, int]:
    counts: Counter = Counter()
    for found in map(known.__getitem__, words_of(text)):
        if found:
            counts.update(found)
    return counts


def _shares(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each term, by label; counts of a batch leave together."""
    schema = pa.schema([("term", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])
    for b in batches:
        n: dict[str, list[int]] = {}
        for text, label in rows_of([b], "text", "toxic"):
            for t in {t for w in set(words_of(text)) for t in terms_of(w)}:
                n.setdefault(t, [0, 0])[1 - label] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array([x[0] for x in n.values()], pa.int64()), pa.array([x[1] for x in n.values()], pa.int64())], schema=schema)


_SCHEMA = "doc_id long, held_out boolean, score double, predicted int, evidence string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("evidence", pa.string())])

ship(__name__)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[DataFrame | None, dict[int, float]]:
    """Texts of the sample (doc_id, text, toxic; written), and how many labelled rows a row of each label stands for."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(
        F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    known = materialise(known)
    sizes = dict(known.groupBy("toxic").count().collect())
    if not sizes:
        return None, {}
    parts = [known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows) for y in sorted(sizes)]
    chosen = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])  # two bounded lists of ids
    chosen = chosen.withColumnRenamed("doc_id", "__doc")
    texts = docs.join(F.broadcast(chosen), docs["doc_id"] == chosen["__doc"]).select("doc_id", "text", "toxic", F.xxhash64("text").alias("tie"))
    texts = materialise(texts.dropDuplicates(["doc_id", "tie", "text"]))
    if any(n > sample_rows for n in dict(texts.groupBy("toxic").count().collect()).values()):
        # several texts of one doc_id: the bound holds for texts, chosen by hashes; the lists hold numbers only
        keys = texts.select(F.col("doc_id").alias("__doc"), F.col("tie").alias("__tie"), "toxic")
        lists = [keys.filter(F.col("toxic") == y).orderBy(F.xxhash64("__doc", "__tie"), "__doc", "__tie").limit(sample_rows).drop("toxic") for y in sorted(sizes)]
        kept = materialise(lists[0] if len(lists) == 1 else lists[0].unionByName(lists[1]))
        texts = materialise(texts.join(F.broadcast(kept), texts["doc_id"].eqNullSafe(kept["__doc"]) & (texts["tie"] == kept["__tie"]), "left_semi"))
    return materialise(texts.repartition(12)), {y: n / min(n, sample_rows) for y, n in sizes.items()}


def telling_terms(sample: DataFrame, most_terms: int = MOST_TERMS) -> list:
    """term, toxic, clean (texts with the term by label) of the vocabulary, most certain first; see the module for the test."""
    texts = sample.groupBy("tie", "text").agg(F.max("toxic").alias("toxic"))
    sizes = dict(texts.groupBy("toxic").count().collect())
    if not (sizes.get(0) and sizes.get(1)):
        return []
    share_toxic = sizes[1] / (sizes[0] + sizes[1])
    least_docs = math.ceil(math.log(LEAST_P) / math.log(min(share_toxic, 1 - share_toxic)))
    shares = texts.mapInArrow(_shares, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    tested = materialise(shares.filter(F.col("toxic") + F.col("clean") >= least_docs))
    n = F.col("toxic") + F.col("clean")
    more_toxic = F.col("toxic") > n * share_toxic
    k = F.when(more_toxic, F.col("toxic")).otherwise(F.col("clean"))
    p = tails.binomial_at_least(k, n, F.when(more_toxic, F.lit(share_toxic)).otherwise(F.lit(1 - share_toxic)))
    best = tested.withColumn("p", p).filter(F.col("p") <= FALSE_SHARE).orderBy("p", F.desc(F.abs(F.col("toxic") - n * share_toxic)), "term").limit(most_terms).collect()
    tests = 2 * tested.count()  # either label
    last = max((r for r, x in enumerate(best, 1) if x["p"] <= FALSE_SHARE * r / tests), default=0)
    return best[:last]


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, most_terms: int = MOST_TERMS) -> Neighbours | None:
    """``docs``: doc_id, text. ``labels``: doc_id, toxic. None if nothing is labelled."""
    sample, stands = labelled_sample(docs, labels, sample_rows)
    if sample is None:
        return None
    found = telling_terms(sample, most_terms)
    total = sum(n * stands[y] for y, n in sample.select(F.xxhash64("text"), "toxic").distinct().groupBy("toxic").count().collect())
    vocabulary = [r["term"] for r in found]
    idf = np.array([1 + math.log(total / (r["toxic"] * stands.get(1, 0) + r["clean"] * stands.get(0, 0))) for r in found])
    numbers = {t: k for k, t in enumerate(vocabulary)}

    def vectors(batches):
        words = Known(numbers)
        schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("tie", pa.int64()), ("terms", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))])

        def rows():
            for doc, toxic, tie, text in rows_of(batches, "doc_id", "toxic", "tie", "text"):
                c = counted(words, text)
                yield doc, toxic, tie, list(c), list(c.values())
        return batched(rows(), schema)
    rows = sample.select("doc_id", "toxic", "tie", "text").mapInArrow(vectors, "doc_id long, toxic int, tie long, terms array<int>, n array<int>").collect()  # at most 2 * sample_rows
    # neighbours in the index share their heaviest term, which keeps the maxima of a block close to its members
    rows.sort(key=lambda r: (r["toxic"], max(r["terms"], key=lambda t: (idf[t], t), default=-1), r["tie"], r["doc_id"]))
    return Neighbours(vocabulary, idf, [(r["doc_id"], r["toxic"], stands[r["toxic"]], dict(zip(r["terms"], r["n"]))) for r in rows])


def scores(docs: DataFrame, model: Neighbours | None) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence (doc_id:label:cosine of the nearest examples) for every row."""
    shared = share(docs.sparkSession, model)

    def work(batches):
        model = pickle.loads(shared.value)
        known = Known(model.vocabulary) if model else None

        def rows():
            for doc, text in rows_of(batches, "doc_id", "text"):
                p, said = model.score(counted(known, text)) if model else (0.0, "")
                yield doc, held_out_id(doc), p, int(p >= CUT), said
        return batched(rows(), _ARROW)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(work, _SCHEMA)


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, folder, "documents", "doc_id", "text")
    return scores(docs, learn(docs, table(spark, folder, "labels", "doc_id", "toxic")))
