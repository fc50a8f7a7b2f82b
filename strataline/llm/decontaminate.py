"""Benchmark decontamination: BM25 over test items with block maxima, then a check of question and answer.

Test items are indexed; every passage of every training text is a query. Passages are windows of words, twice as long as the longest
item of a length class and half overlapping, so an item that is copied into a text lies in one passage whole. A passage retrieves all
items whose BM25 score reaches ``THRESHOLD`` of the item's score for itself (block bounds prune, results are those of scoring every
item). Each retrieved item is checked on five-word shingles: the shares of the question's, the answer's and the whole item's shingles
that occur in the passage. It counts as contamination where question and answer both, or the whole, reach ``OVERLAP``.

Test sets larger than ``SHARD_ITEMS`` are searched shard by shard, with document frequencies over all items; a shard is the most that
is broadcast. Texts are read where they lie: there is no shuffle of the training data.

Defined results
* Words are runs of letters and digits, case folded. Items or texts without words, and nulls, match nothing.
* An item under five words must occur as one whole shingle. Items with equal text are all reported.
* An answer without words counts as found. Repeated rows each give their own result; extra columns are ignored or passed through.
* Empty tables on either side give no pairs, and ``keep_clean`` then keeps every row.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blockmax import BlockMax
from .common import batched, prepare, rows_of, share, ship, table

THRESHOLD = 0.5
OVERLAP = 0.8
SHINGLE = 5
#: Items that one index (and broadcast) holds at most.
SHARD_ITEMS = 20_000
K1, B = 1.2, 0.75
#: Terms whose weight is below this share of the threshold are left to the slack.
LIGHT = 0.004
#: Words that are searched at a time.
CHUNK = 60_000

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def shingles(words: list[str], n: int = SHINGLE) -> set[tuple[str, ...]]:
    n = min(n, len(words))
    return set(zip(*[words[i:] for i in range(n)])) if n else set()


def split_answer(text: str | None) -> tuple[str, str]:
    """Question and answer of an item that is one text: the answer is its last sentence, if there is more than one."""
    parts = re.split(r"(?<=[.!?])\s+|\n+", (text or "").strip())
    if len(parts) < 2:
        return text or "", ""
    at = (text or "").rindex(parts[-1])
    return text[:at], parts[-1]


class Items:
    """Index of one shard. ``rows``: item_id, question, answer. ``idf``: weight of a term over all items."""

    def __init__(self, rows: list[tuple], idf: Callable[[str], float], average: float):
        self.rows, self.words = [], []
        for item_id, question, answer in rows:
            q, a = words_of(question), words_of(answer)
            if q or a:
                self.rows.append((item_id, q, a))
                self.words.append(q + a)
        self.vocabulary: dict[str, int] = {}
        item, term, weight = [], [], []
        for k, words in enumerate(self.words):
            counts = Counter(words)
            scale = K1 * (1 - B + B * len(words) / average)
            w = {t: idf(t) * n * (K1 + 1) / (n + scale) for t, n in counts.items()}
            own = sum(w.values())
            for t, x in w.items():
                item.append(k)
                term.append(self.vocabulary.setdefault(t, len(self.vocabulary)))
                weight.append(x / own)  # a share of the item's score for itself
        self.item, self.term, self.weight = np.array(item, np.int64), np.array(term, np.int64), np.array(weight)
        # a class of items by length: passages of twice its longest item
        length = np.array([len(w) for w in self.words], np.int64)
        self.classes = []
        size = 32
        while len(length) and (size == 32 or size < 2 * length.max()):
            own = np.flatnonzero((length <= size) & (length > (size // 2 if size > 32 else 0)))
            if len(own):
                number = np.full(len(length), -1)
                number[own] = np.arange(len(own))
                part = number[self.item] >= 0
                self.classes.append((size, own, BlockMax(number[self.item[part]], self.term[part], self.weight[part], len(own), len(self.vocabulary))))
            size *= 2
        self._shingles: dict[int, tuple[set, set, set]] = {}

    def parts(self, k: int) -> tuple[set, set, set]:
        if k not in self._shingles:
            _, q, a = self.rows[k]
            self._shingles[k] = shingles(q), shingles(a), shingles(q + a)
        return self._shingles[k]

    def overlaps(self, k: int, passage: list[str]) -> tuple[float, float, float]:
        """Shares of the shingles of question, answer and whole item that the passage has."""
        out = []
        for want in self.parts(k):
            n = len(next(iter(want))) if want else 0
            out.append(len(want & shingles(passage, n)) / len(want) if want and n <= len(passage) else 0.0 if want else 1.0)
        return out[0], out[1], out[2]

    def find(self, texts: list[str | None]) -> Iterator[tuple[int, int, float, float, float, float]]:
        """(text number, item number, score, overlaps) of every contaminated pair, the best passage of each."""
        get = self.vocabulary.get
        all_words = [words_of(t) for t in texts]
        sizes = np.array([len(w) for w in all_words], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        term = np.fromiter((get(w, -1) for ws in all_words for w in ws), np.int64, int(starts[-1]))
        at = np.flatnonzero(term >= 0)
        term = term[at]
        doc = np.searchsorted(starts, at, side="right") - 1
        place = at - starts[doc]
        best: dict[tuple[int, int], tuple] = {}
        for size, own, index in self.classes:
            used = index.size[term] > 0
            d, p, t = doc[used], place[used], term[used]
            # window v of a text covers its words [v * size, (v + 2) * size)
            windows = np.maximum(1, -(-sizes // size))
            base = np.concatenate([[0], np.cumsum(windows)])
            v = p // size
            back = v > 0
            key = np.unique(np.concatenate([base[d] + v, base[d[back]] + v[back] - 1]) * index.terms + np.concatenate([t, t[back]]))
            query, terms = key // index.terms, key % index.terms
            for q, k, score in zip(*index.search(query, terms, np.ones(len(terms)), THRESHOLD, LIGHT * THRESHOLD * 32 / size)):
                n = int(np.searchsorted(base, q, side="right") - 1)
                first = int(q - base[n]) * size
                overlap = self.overlaps(int(own[k]), all_words[n][first:first + 2 * size])
                if overlap[2] >= OVERLAP or min(overlap[:2]) >= OVERLAP:
                    pair = (n, int(own[k]))
                    best[pair] = max(best.get(pair, (0.0,)), (float(score), *overlap))
        for (n, k), found in sorted(best.items()):
            yield n, k, *found


def chunks(batches: Iterable[pa.RecordBatch], *columns: str) -> Iterator[list[tuple]]:
    """Rows in groups of about ``CHUNK`` words (by length); the last column is the text."""
    held, size = [], 0
    for r in rows_of(batches, *columns):
        held.append(r)
        size += len(r[-1] or "")
        if size > 6 * CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


_SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, overlap double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), *[(c, pa.float64()) for c in ("score", "question_overlap", "answer_overlap", "overlap")]])

ship(__name__)


def shards(items: DataFrame, shard_items: int = SHARD_ITEMS) -> Iterator[Items]:
    """Indexes that hold all items together. ``items``: item_id, question, answer."""
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), "question", "answer")
    total = items.count()
    pieces = max(1, -(-total // shard_items))
    # document frequencies and lengths over all items, counted by Spark
    said = F.concat_ws(" ", F.coalesce("question", F.lit("")), F.coalesce("answer", F.lit("")))

    def counted(batches):
        def rows():
            for (text,) in rows_of(batches, "text"):
                w = words_of(text)
                yield len(w), sorted(set(w))
        return batched(rows(), pa.schema([("n", pa.int64()), ("terms", pa.list_(pa.string()))]))
    terms = items.select(said.alias("text")).mapInArrow(counted, "n long, terms array<string>").filter("n > 0")
    n, words = terms.agg(F.count(F.lit(1)), F.sum("n")).head()
    if not n:
        return
    df = terms.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    for k in range(pieces):
        part = items if pieces == 1 else items.filter(F.pmod(F.xxhash64("item_id", "question", "answer"), F.lit(pieces)) == k)
        rows = [tuple(r) for r in part.collect()]  # about shard_items of them
        own = df
        if pieces > 1:
            used = sorted({t for _, q, a in rows for t in {*words_of(q), *words_of(a)}})
            own = df.join(items.sparkSession.createDataFrame([(t,) for t in used], "term string"), "term", "left_semi") if used else df.limit(0)
        freq = dict(own.collect())  # terms of the shard
        yield Items(rows, lambda t, f=freq: float(np.log(1 + (n - f[t] + 0.5) / (f[t] + 0.5))), words / n)


def one_text(benchmark: DataFrame) -> DataFrame:
    """Items given as one text, split into question and answer."""
    def work(batches):
        schema = pa.schema([("item_id", pa.int64()), ("question", pa.string()), ("answer", pa.string())])
        return batched(((i, *split_answer(t)) for i, t in rows_of(batches, "item_id", "text")), schema)
    return benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").mapInArrow(work, "item_id long, question string, answer string")


def contaminated_pairs(docs: DataFrame, items: DataFrame, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """doc_id, item_id, score and overlaps of every item found in every text of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    out = None
    for index in shards(items, shard_items):
        shared = share(spark, index)

        def work(batches, shared=shared):
            index = pickle.loads(shared.value)

            def rows():
                for part in chunks(batches, "doc_id", "text"):
                    for n, k, *found in index.find([t for _, t in part]):
                        yield part[n][0], index.rows[k][0], *found
            return batched(rows(), _ARROW)
        found = docs.mapInArrow(work, _SCHEMA)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], _SCHEMA) if out is None else out


def keep_clean(docs: DataFrame, items: DataFrame, text: str = "text", shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Rows of ``docs``, all columns, whose text holds no item."""
    at, schema = docs.columns.index(text), docs.schema
    for index in shards(items, shard_items):
        shared = share(docs.sparkSession, index)

        def work(batches, shared=shared):
            index = pickle.loads(shared.value)
            for b in batches:
                texts, bad, first = b.column(at).to_pylist(), set(), 0
                for part in chunks([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])], "text"):
                    bad |= {first + n for n, *_ in index.find([t for (t,) in part])}
                    first += len(part)
                yield b.filter(pa.array([i not in bad for i in range(b.num_rows)], pa.bool_()))
        docs = docs.mapInArrow(work, schema)
    return docs


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    prepare(spark)
    return contaminated_pairs(table(spark, folder, "documents", "doc_id", "text"), one_text(table(spark, folder, "benchmark", "item_id", "text")))
