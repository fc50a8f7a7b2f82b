"""Language-model scoring by context-tree weighting over bytes.

A text is its bytes (A-Z in lower case) and an end mark; the context of a byte are the ``DEPTH`` bytes before it, with start marks before the
text. A byte is eight binary decisions. Each decision (a node of the binary tree over byte values) has a context tree of its own: at the
node of every context of 0 to ``DEPTH`` bytes the Krichevsky-Trofimov estimate of the zeros and ones seen there is mixed, half and half,
with the product of what its longer contexts say. The probability of a decision is then the mixture, over all depths, of the
estimates on the path of its context, each weighing what the training texts give it. Contexts never seen say one half.

How it runs, on Spark throughout:

* the byte grams (context and byte) of all texts are counted, those of training texts apart; equal grams combine before the shuffle
* from the grams come the nodes of the longest contexts, and level by level, each from the one below, those of shorter contexts: sums of
  counts and of log probabilities over at most 256 longer contexts
* level by level downwards the estimates are mixed; every gram of the corpus gets its code length, also the ones never seen in training
* a text is the sum over its grams. The ``MOST_GRAMS`` most frequent ones are sent to the tasks, the others go through a join (see
  ``lookup``). The unigram base of the score is summed the same way, over words.

Nothing depends on the size of the corpus but the number of rows. Texts are read in runs of ``RUN`` bytes, whole, whatever their length.

Defined results
* Null text counts as empty: its probability is that of the end mark after the start marks. A null doc_id is not held out.
* Nothing to learn from: every decision has one half (log10 of 1/256 a byte); the base is 0.
* Repeated rows count as often as they occur in training and each give a row. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
import pickle
import uuid
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from .common import kept_in_worker, prepare, rows_of, share, ship, table
from .lookup import Numbers, frequent

#: Bytes of the longest context; a gram has one byte more and must fit into 55 bits together with eight for the node.
DEPTH = 5
#: The byte that stands for start and end; it does not occur in UTF-8.
MARK = b"\xff"
#: Grams and words whose figures are sent to every task; the others are joined.
MOST_GRAMS, MOST_WORDS = 1 << 21, 1 << 18
#: Bytes of a text that are worked on at a time, and numbers that a task holds before it sums them up.
RUN, HELD = 1 << 20, 1 << 22
LN2 = math.log(2)


def held_out_id(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def folded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def runs(said: bytes, depth: int = DEPTH) -> Iterator[np.ndarray]:
    """The text with its marks, in pieces; each begins with the ``depth`` bytes before it."""
    whole = MARK * depth + said + MARK
    for a in range(0, len(whole) - depth, RUN):
        yield np.frombuffer(whole, np.uint8, min(RUN + depth, len(whole) - a), a)


def grams(pieces: list[np.ndarray], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Grams (depth + 1 bytes as one number) of the pieces one after another, and how many each piece has."""
    size = np.array([len(p) - depth for p in pieces], np.int64)
    joined = np.concatenate(pieces).astype(np.int64)
    out = joined[:len(joined) - depth].copy()
    for k in range(1, depth + 1):
        out <<= 8
        out |= joined[k:len(joined) - depth + k]
    # grams that begin in the last ``depth`` bytes of a piece reach into the next one
    inner = np.ones(len(joined), bool)
    ends = np.cumsum(size + depth)
    for k in range(depth):
        inner[ends - 1 - k] = False
    return out[inner[:len(out)]], size


def words(said: bytes) -> Iterator[list[bytes]]:
    """Words between ASCII white space, some million bytes of the text at a time."""
    at = 0
    while at < len(said):
        end = at + RUN
        while end < len(said) and said[end] not in b" \t\n\v\f\r":
            end += 1
        yield said[at:end].split()
        at = end


def word_key(word: bytes) -> bytes:
    """Short words for themselves, long ones as a digest behind a byte that no word has."""
    return word if len(word) < 24 else MARK + xxhash.xxh3_128_digest(word)


def text_key(said: bytes) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(said)
    return tuple(int.from_bytes(digest[k:k + 8], "big", signed=True) for k in (0, 8))


_GRAMS = pa.schema([("gram", pa.int64()), ("n", pa.int64()), ("train", pa.int64())])
_WORDS = pa.schema([("word", pa.binary()), ("n", pa.int64()), ("train", pa.int64())])
_ROWS = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("ka", pa.int64()), ("kb", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                   ("base_score", pa.float64()), ("score", pa.float64()), ("gram", pa.int64()), ("word", pa.binary()), ("n", pa.int64())])
_ROWS_DDL = "doc_id long, held_out boolean, ka long, kb long, n_tokens long, n_known long, base_score double, score double, gram long, word binary, n long"


def _summed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_counts=True)


def _gram_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams with their numbers in all and in training texts, summed over what a task can hold."""
    def batch(held):
        key, own = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        n = np.bincount(own, np.concatenate([n for _, n in held])).astype(np.int64)
        return key, n

    def out(key, n):
        # the lowest bit tells grams of training texts
        return pa.RecordBatch.from_arrays([pa.array(key >> 1), pa.array(n), pa.array(np.where(key & 1, n, 0))], schema=_GRAMS)
    held, size, pieces, length = [], 0, [], 0

    def close():
        nonlocal held, size, pieces, length
        every, sizes = grams([p for p, _ in pieces])
        held.append(_summed(every << 1 | np.repeat(np.array([t for _, t in pieces], np.int64), sizes)))
        size += len(held[-1][0])
        pieces, length = [], 0
    for doc, text in rows_of(batches, "doc_id", "text"):
        train = not held_out_id(doc)
        for p in runs(folded(text)):
            pieces.append((p, train))
            length += len(p)
            if length >= HELD:
                close()
        if size > HELD:
            held = [batch(held)]
            size = len(held[0][0])
            if size > HELD // 2:
                yield out(*held[0])
                held, size = [], 0
    if pieces:
        close()
    if held:
        yield out(*batch(held))


def _word_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    every, train = Counter(), Counter()

    def out():
        key = list(map(word_key, every))
        return pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(every.values(), pa.int64()), pa.array([train[w] for w in every], pa.int64())], schema=_WORDS)
    for doc, text in rows_of(batches, "doc_id", "text"):
        for part in words(folded(text)):
            every.update(part)
            if not held_out_id(doc):
                train.update(part)
        if len(every) > HELD // 16:
            yield out()
            every, train = Counter(), Counter()
    if every:
        yield out()


def log_gamma(x: Column) -> Column:
    """Of a positive number, by the series for x + 8."""
    y, product = x + 8, x
    for k in range(1, 8):
        product = product * (x + k)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - F.log(product)


def log_kt(zeros: Column, ones: Column) -> Column:
    """Krichevsky-Trofimov: log probability of a sequence with these numbers of zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def levels(counts: DataFrame, depth: int = DEPTH) -> list[DataFrame]:
    """Nodes by depth of their context, 0 to ``depth``: key (context bytes, then the node of the byte's binary tree), zeros, ones, ``own`` (log
    probability of the estimate here) and ``mixed`` (of the weighted mixture with the longer contexts). ``counts``: gram, train."""
    node = F.explode(F.array(*[F.struct(
        (F.shiftright("gram", 8) * 256 + F.shiftright((F.col("gram").bitwiseAND(255)) + 256, 8 - j)).alias("key"),
        F.shiftright("gram", 7 - j).bitwiseAND(1).alias("bit")) for j in range(8)]))
    one = F.col("x.bit").cast("double")
    below = counts.select("train", node.alias("x")).groupBy(F.col("x.key").alias("key")).agg(
        F.sum(F.col("train") * (1 - one)).alias("zeros"), F.sum(F.col("train") * one).alias("ones"))
    below = materialise(below.withColumn("own", log_kt(F.col("zeros"), F.col("ones"))).withColumn("mixed", F.col("own")))
    out = [below]
    for d in range(depth - 1, -1, -1):
        shorter = F.col("key").bitwiseAND(F.lit((1 << (8 * d + 8)) - 1))
        up = below.groupBy(shorter.alias("key")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("mixed").alias("longer"))
        up = up.withColumn("own", log_kt(F.col("zeros"), F.col("ones")))
        high, low = F.greatest("own", "longer"), F.least("own", "longer")
        below = materialise(up.withColumn("mixed", high + F.log1p(F.exp(low - high)) - LN2).drop("longer"))
        out.append(below)
    return out[::-1]


def code_lengths(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """gram, n, and the log10 probability of its last byte after the others, for every gram of ``counts`` (gram, n, train; train may be 0)."""
    tree = levels(counts, depth)
    path = None
    for d, nodes in enumerate(tree):
        stay = F.lit(1.0) if d == depth else F.exp(F.col("own") - LN2 - F.col("mixed"))
        here = nodes.select("key", stay.alias("stay"), ((F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1)).alias("one"))
        if path is None:
            path = here.withColumns({"left": F.lit(1.0), "so_far": F.lit(0.0)})
        else:
            up = path.select(F.col("key").alias("up"), "left", "so_far")
            path = here.join(up, F.col("key").bitwiseAND(F.lit((1 << (8 * d)) - 1)) == F.col("up"))
        # ``left``: what the shorter contexts leave to this one; ``so_far``: what they and this one say together
        path = materialise(path.select("key", (F.col("left") * (1 - F.col("stay"))).alias("left"), (F.col("so_far") + F.col("left") * F.col("stay") * F.col("one")).alias("so_far")))
    node = F.explode(F.array(*[F.struct(
        (F.shiftright("gram", 8) * 256 + F.shiftright((F.col("gram").bitwiseAND(255)) + 256, 8 - j)).alias("key"),
        F.shiftright("gram", 7 - j).bitwiseAND(1).alias("bit")) for j in range(8)]))
    bits = counts.select("gram", "n", node.alias("x")).select("gram", "n", "x.*")
    said = F.when(F.col("bit") == 1, F.col("so_far")).otherwise(1 - F.col("so_far"))
    met = bits.join(path.select(F.col("key").alias("node"), "so_far"), F.col("key") == F.col("node"))
    return met.groupBy("gram").agg(F.max("n").alias("n"), F.sum(F.log10(said)).alias("code"))


def score(docs: DataFrame, most_grams: int = MOST_GRAMS, most_words: int = MOST_WORDS) -> DataFrame:
    """doc_id, held_out, token figures, base_score and score of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    counts = materialise(docs.mapInArrow(_gram_counts, "gram long, n long, train long").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("train").alias("train")))
    codes = materialise(code_lengths(counts))
    vocabulary = materialise(docs.mapInArrow(_word_counts, "word binary, n long, train long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("train").alias("train")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    ends = docs.filter(~held).count()
    seen, kinds = vocabulary.agg(F.coalesce(F.sum("train"), F.lit(0)), F.count_if(F.col("train") > 0)).head()
    total, scale = seen + ends, seen + ends + (kinds + (ends > 0) + 1)
    end = math.log10((ends + 1) / scale)
    top_grams, top_words = frequent(codes, "n", most_grams).toArrow(), frequent(vocabulary, "n", most_words).toArrow()
    shared = share(spark, (top_grams.column("gram").to_numpy(), top_grams.column("code").to_numpy(), dict(zip(top_words.column("word").to_pylist(), top_words.column("train").to_pylist()))))
    name = uuid.uuid4().hex

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make():
            gram, code, known = pickle.loads(shared.value)
            return Numbers(gram), np.append(code, 0.0), {w: (math.log10((c + 1) / scale), c > 0) for w, c in known.items()}
        numbers, code, known = kept_in_worker(("context tree", name), make)
        main: list[list] = [[] for _ in range(8)]
        rest: list[list] = [[] for _ in range(5)]  # ka, kb, gram, word, n

        def summed(rows):
            """Row figures; rare grams and words go to ``rest``."""
            pieces, own = [], []
            for k, (doc, text) in enumerate(rows):
                said = folded(text)
                key = text_key(said)
                pieces_of = list(runs(said))
                pieces += pieces_of
                own += [k] * len(pieces_of)
                n_tokens, n_known, base = 1, int(ends > 0), [end]
                for part in words(said):
                    n_tokens += len(part)
                    for w, n in Counter(part).items():
                        figure = known.get(word_key(w))
                        if figure is None:
                            for c, v in zip(rest, (*key, None, word_key(w), n)):
                                c.append(v)
                        else:
                            base.append(n * figure[0])
                            n_known += n * figure[1]
                for c, v in zip(main, (doc, held_out_id(doc), *key, n_tokens, n_known, math.fsum(base), 0.0)):
                    c.append(v)
            first = len(main[0]) - len(rows)
            for a in range(0, len(pieces), 64):
                every, size = grams(pieces[a:a + 64])
                at = numbers.find(every)
                row = np.repeat(np.array(own[a:a + 64]), size)
                part = np.bincount(row, code[at], len(rows))
                for k in np.unique(own[a:a + 64]).tolist():
                    main[7][first + k] += float(part[k])
                rare = np.flatnonzero(at < 0)
                if len(rare):
                    order = rare[np.lexsort((every[rare], row[rare]))]
                    g, r = every[order], row[order]
                    new = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (r[1:] != r[:-1])]))
                    for c, v in zip(rest, ([main[2][first + k] for k in r[new].tolist()], [main[3][first + k] for k in r[new].tolist()], g[new].tolist(), [None] * len(new), np.diff(np.append(new, len(g))).tolist())):
                        c.extend(v)

        def flush():
            n, m = len(main[0]), len(rest[0])
            cols = [*main, [None] * n, [None] * n, [0] * n]
            tail = [[None] * m, [None] * m, rest[0], rest[1], *[[None] * m] * 4, *rest[2:]]
            for part in (cols, tail):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(part, _ROWS)], schema=_ROWS)
            for c in [*main, *rest]:
                c.clear()
        held_rows, size = [], 0
        for row in rows_of(batches, "doc_id", "text"):
            held_rows.append(row)
            size += len(row[1] or "") + DEPTH + 1
            if size > RUN:
                summed(held_rows)
                held_rows, size = [], 0
                yield from flush()
        if held_rows:
            summed(held_rows)
            yield from flush()
    found = materialise(docs.mapInArrow(work, _ROWS_DDL))
    main = found.filter(F.col("n") == 0).drop("gram", "word", "n")
    zero, none = F.lit(0).cast("bigint"), F.lit(0.0)

    def more(rows, known, base, code, times):
        return rows.groupBy("ka", "kb").agg(F.sum(known).alias("known"), F.sum(base).alias("base"), F.sum(code).alias("code"), F.sum(times).alias("times"))
    rare_grams = found.filter(F.col("gram").isNotNull()).select("ka", "kb", F.col("gram").alias("g"), F.col("n").alias("times"))
    rare_words = found.filter(F.col("word").isNotNull()).select("ka", "kb", F.col("word").alias("w"), F.col("n").alias("times"))
    by_gram = more(rare_grams.join(codes, F.col("g") == F.col("gram")), zero, none, F.col("times") * F.col("code"), zero)
    by_word = more(rare_words.join(vocabulary, F.col("w") == F.col("word")), F.when(F.col("train") > 0, F.col("times")).otherwise(zero), F.col("times") * F.log10((F.col("train") + 1) / F.lit(float(scale))), none, zero)
    # a text that several rows have has its rare grams and words several times
    rows = more(main, zero, none, none, F.lit(1).cast("bigint"))
    extra = by_gram.unionByName(by_word).unionByName(rows).groupBy("ka", "kb").agg(*[F.sum(c).alias(c) for c in ("known", "base", "code", "times")])
    # dealt by a hash of its own, so that a text on a third of all rows can be split
    extra = extra.select(F.xxhash64("ka", "kb").alias("key"), F.col("ka").alias("a"), F.col("kb").alias("b"), F.expr("known div times").alias("known"), (F.col("base") / F.col("times")).alias("base"), (F.col("code") / F.col("times")).alias("code"))
    out = main.withColumn("mine", F.xxhash64("ka", "kb")).join(extra, (F.col("mine") == F.col("key")) & (F.col("ka") == F.col("a")) & (F.col("kb") == F.col("b")))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("known")).alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"),
                      (F.col("base_score") + F.col("base")).alias("base_score"), (F.col("score") + F.col("code")).alias("score"))


ship(__name__)


def op11_context_tree(spark: SparkSession, folder: str) -> DataFrame:
    prepare(spark)
    return score(table(spark, folder, "documents", "doc_id", "text"))
