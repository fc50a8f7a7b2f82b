"""Ranked lexical search with geometric blocking of the posting lists.

Every document is a vector of impacts, one for each term, so that a score is the product of an item's weights and the vector. Documents are indexed
in segments. In a segment the posting list of each term is cut into blocks by the similarity of its documents: their vectors are
projected to a few dimensions, some of them lead, and every document joins the leader it is closest to. A block stores the
coordinatewise maximum of its vectors. The product of an item's weights with that summary is at least the score of every document in the
block, so a block is skipped only if this exact bound is below the item's k-th best score so far; the documents of the other blocks are scored.

A document with a positive score is in the list of each item term that it holds, so looking at one of these lists is enough. An item's
terms are visited from the rarest; the rest of them is left out once their largest impacts together stay below the k-th best score.

How it runs: one pass over the texts writes a vector for each document (terms of the items only, with the number of all its terms). Corpus
figures come from these rows. Each task then indexes its vectors segment by segment, searches all items and keeps its k best of each;
the best of all tasks are taken in two steps, so that no task gets all candidates of an item at once. Items are searched in groups of
``GROUP_ITEMS``; all of them (ids and terms, ``MOST_ITEMS`` at most, beyond that one pass for each shard) are broadcast.

Defined results
* Null texts and texts without terms are no documents; items without a term found in the corpus have no rows.
* Equal scores by ascending doc_id, null ids last, then by a hash of the text. Repeated rows are documents of their own.
* Repeated item rows: one result for each different (item_id, text). Extra columns are ignored. Empty tables on either side give no rows.
* Texts of any length are read whole, one at a time.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise
from .blockmax import ranges
from .common import batched, prepare, rows_of, share, ship, table

TOP = 10
#: Items of one broadcast; larger sets are searched shard by shard.
MOST_ITEMS = 20_000
#: Items that are searched together in a segment.
GROUP_ITEMS = 500
#: Documents of a segment at most, and cells (documents x terms) of one.
SEGMENT, CELLS = 4096, 1 << 24
#: Documents of a block on average, and dimensions of the projection that decides which documents go together.
BLOCK, DIMENSIONS = 32, 16
#: Partitions in which the candidates of an item meet first.
SALTS = 32

# ASCII letters (in lower case), digits and every byte of a character beyond ASCII belong to a term
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TERM).split() if text else []


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Items:
    """Items with the numbers of their terms."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        self.ids, self.terms, self.number = [], [], {}
        for item, text in rows:
            own = dict.fromkeys(terms_of(text))
            if own:
                self.ids.append(item)
                self.terms.append([self.number.setdefault(t, len(self.number)) for t in own])


class Group:
    """Some items: which terms they hold, and the dense matrix of their weights."""

    def __init__(self, terms: list[list[int]], weights: np.ndarray):
        self.terms = np.unique([t for x in terms for t in x]) if terms else np.zeros(0, np.int64)
        self.own = [np.searchsorted(self.terms, x) for x in terms]
        self.weight = np.zeros((len(self.terms), len(terms)))
        for k, x in enumerate(self.own):
            self.weight[x, k] = weights[self.terms[x]]
        self.items_of = [np.flatnonzero(r) for r in self.weight > 0]


class Best:
    """The k best documents of each item so far; scores are whole numbers below 2**53, which doubles hold exactly."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.zeros(items)
        self.held: list[list[tuple]] = [[] for _ in range(items)]

    def add(self, item: int, scores: np.ndarray, keys: list[tuple]) -> None:
        """``keys``: doc_id rank, doc_id, hash of each document."""
        rows = self.held[item] + [(-s, *key) for s, key in zip(scores.tolist(), keys)]
        rows.sort()
        self.held[item] = rows[:self.k]
        if len(self.held[item]) == self.k:
            self.least[item] = -self.held[item][-1][0]


def blocks(vectors: np.ndarray, near: np.ndarray, size: int = BLOCK) -> list[np.ndarray]:
    """Documents (rows of ``vectors``) grouped by similarity of their projections ``near``."""
    n = len(vectors)
    leaders = -(-n // size)
    if leaders < 2:
        return [np.arange(n)]
    lead = near[np.linspace(0, n - 1, leaders).astype(np.int64)]
    own = np.argmax(near @ lead.T, axis=1)
    order = np.argsort(own, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(own[order])) + 1)


def search(group: Group, impact: np.ndarray, keys: list[tuple], best: Best, first: int, opened: Counter | None = None, block: int = BLOCK) -> None:
    """Add the documents of one segment to the best of each item of ``group`` (numbered from ``first`` on). ``impact``: documents x
    terms of the group."""
    if not len(impact) or not len(group.terms):
        return
    direction = np.random.default_rng(len(group.terms)).standard_normal((len(group.terms), DIMENSIONS)).astype(np.float32)
    near = impact @ direction
    near /= np.maximum(np.linalg.norm(near, axis=1, keepdims=True), 1e-30)
    most = impact.max(axis=0).astype(np.float64)
    seen = np.zeros((len(impact), group.weight.shape[1]), bool)
    # what is still to be gained by an item's terms from here on, visiting the heaviest terms first
    reach = [most[x] * group.weight[x, k] for k, x in enumerate(group.own)]
    order = [np.argsort(-group.weight[x, k], kind="stable") for k, x in enumerate(group.own)]
    left = {}
    for k, (x, r, o) in enumerate(zip(group.own, reach, order)):
        rest = np.cumsum(r[o][::-1])[::-1]
        for t, gain in zip(x[o].tolist(), rest.tolist()):
            left[t, k] = gain
    for t in np.argsort(-group.weight.max(axis=1), kind="stable").tolist():
        items = np.array([k for k in group.items_of[t].tolist() if left[t, k] >= best.least[first + k] and left[t, k] > 0], np.int64)
        docs = np.flatnonzero(impact[:, t])
        if not len(items) or not len(docs):
            continue
        parts = blocks(impact[docs], near[docs], block)
        size = np.array([len(p) for p in parts])
        members = docs[np.concatenate(parts)]
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        used = np.unique(np.concatenate([group.own[k] for k in items]))
        summary = np.maximum.reduceat(impact[np.ix_(members, used)], starts, axis=0).astype(np.float64)
        bound = summary @ group.weight[np.ix_(used, items)]
        if opened is not None:
            opened["blocks"] += bound.size
        for j in np.argsort(-bound.max(axis=0)).tolist():
            k = int(items[j])
            # the blocks with the highest bounds first: they raise the k-th best score
            todo = np.argsort(-bound[:, j], kind="stable")
            at, step = 0, 2
            while at < len(todo):
                go = todo[at:at + step]
                go = go[bound[go, j] >= best.least[first + k]]
                if not len(go):
                    break
                at, step = at + step, step * 2
                if opened is not None:
                    opened["opened"] += len(go)
                rows = members[ranges(starts[go], size[go])]
                rows = rows[~seen[rows, k]]
                seen[rows, k] = True
                score = impact[np.ix_(rows, group.own[k])].astype(np.float64) @ group.weight[group.own[k], k]
                good = score >= max(best.least[first + k], 1)
                if good.any():
                    best.add(first + k, score[good], [keys[r] for r in rows[good].tolist()])


_VECTOR = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tf", pa.list_(pa.int64()))])
_FOUND = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("score", pa.int64())])

ship(__name__)


def vectors(docs: DataFrame, items: Items) -> DataFrame:
    """doc_id, a hash of the text, the number of its terms, and number and frequency of the terms that items hold; texts without terms have no row."""
    shared = share(docs.sparkSession, items.number)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = pickle.loads(shared.value).get

        def row(doc, text):
            words = terms_of(text)
            own = sorted((k, n) for k, n in ((get(w), n) for w, n in Counter(words).items()) if k is not None)
            tie = int.from_bytes(xxhash.xxh3_64_digest((text or "").encode("utf-8", "surrogatepass")), "big", signed=True)
            return doc, tie, len(words), [k for k, _ in own], [n for _, n in own]
        return batched((r for r in (row(*x) for x in rows_of(batches, "doc_id", "text")) if r[2]), _VECTOR)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(work, "doc_id long, tie long, n long, terms array<int>, tf array<long>")


def _search(docs: DataFrame, items: Items, k: int) -> DataFrame:
    spark = docs.sparkSession
    found = materialise(vectors(docs, items))
    total, words = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).head()
    df = np.zeros(len(items.number), np.int64)
    for term, n in found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect():  # terms of the items
        df[term] = n
    weights = np.array([weight(total, int(n)) if n else 0 for n in df], np.float64)
    shared = share(spark, (items.terms, weights))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weights = pickle.loads(shared.value)
        groups = [Group(terms[g:g + GROUP_ITEMS], weights) for g in range(0, len(terms), GROUP_ITEMS)]
        best = Best(len(terms), k)
        width = max([1, *[len(g.terms) for g in groups]])
        most = max(64, min(SEGMENT, CELLS // width))

        def segment(rows):
            keys = [(doc is None, doc or 0, tie) for doc, tie, *_ in rows]
            size = np.array([len(r[3]) for r in rows], np.int64)
            doc = np.repeat(np.arange(len(rows)), size)
            term = np.fromiter((t for r in rows for t in r[3]), np.int64, int(size.sum()))
            tf = np.fromiter((x for r in rows for x in r[4]), np.int64, int(size.sum()))
            m = 100 - 90 + (90 * np.array([r[2] for r in rows], np.int64) * total) // max(words, 1)
            value = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
            for g, group in enumerate(groups):
                at = np.minimum(np.searchsorted(group.terms, term), max(0, len(group.terms) - 1))
                own = group.terms[at] == term if len(group.terms) else np.zeros(len(term), bool)
                impact = np.zeros((len(rows), len(group.terms)), np.float32)  # impacts are below 2**24: exact
                impact[doc[own], at[own]] = value[own]
                search(group, impact, keys, best, g * GROUP_ITEMS)
        held = []
        for r in rows_of(batches, "doc_id", "tie", "n", "terms", "tf"):
            if r[3]:
                held.append(r)
            if len(held) >= most:
                segment(held)
                held = []
        if held:
            segment(held)
        yield from batched(((i, None if none else doc, tie, int(-s)) for i, rows in enumerate(best.held) for s, none, doc, tie in rows), _FOUND)
    near = found.mapInArrow(work, "item int, doc_id long, tie long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("tie")]
    salt = F.pmod(F.xxhash64("doc_id", "tie"), F.lit(SALTS))
    first = near.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).filter(F.col("rank") <= k)
    last = first.drop("salt").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
    ids = spark.createDataFrame(list(enumerate(items.ids)), "number int, item_id long")
    return last.join(ids, F.col("item") == F.col("number")).select("item_id", "rank", "doc_id", "score")


def best_documents(docs: DataFrame, benchmark: DataFrame, k: int = TOP, most_items: int = MOST_ITEMS) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents of every item. ``docs``: doc_id, text; ``benchmark``: item_id, text."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct()
    total = items.count()
    pieces = max(1, -(-total // most_items))
    out = None
    for p in range(pieces):
        part = items if pieces == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(pieces)) == p)
        held = Items([tuple(r) for r in part.orderBy("item_id", "text").collect()])  # about most_items of them, each different
        if held.ids:
            found = _search(docs, held, k)
            out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    prepare(spark)
    return best_documents(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "benchmark", "item_id", "text"))


OP12_SQL = r"""
WITH doc_terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM doc_terms GROUP BY doc_id, term),
lengths AS (SELECT doc_id, count(*) AS n FROM doc_terms GROUP BY doc_id),
corpus AS (SELECT count(*) AS total, CAST(sum(n) AS BIGINT) AS words FROM lengths),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
item_terms AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
weights AS (SELECT i.item_id, i.term, CAST(floor(1000 * ln((2 * c.total + 2) / (2 * d.df + 1))) AS BIGINT) AS w FROM item_terms i JOIN df d USING (term), corpus c),
scores AS (
  SELECT w.item_id, t.doc_id, CAST(sum(w.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * (100 - 90 + (90 * l.n * c.total) // c.words)))) AS BIGINT) AS score
  FROM weights w JOIN tf t USING (term) JOIN lengths l USING (doc_id), corpus c GROUP BY w.item_id, t.doc_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
