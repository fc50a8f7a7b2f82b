"""Language identification as a multilingual mixture, by expectation-maximisation.

Model: for every learned language, smoothed frequencies of character trigrams inside words (hashed into a fixed number of cells, so the
model is bounded whatever the script), from a bounded sample of labelled rows. A document is a sequence of words; the likelihood of a
word under a language is the product of its trigram probabilities. EM estimates the proportions of the languages in the document. The
set of languages is selected by penalised likelihood: starting from the best single language, a language is added while the
log-likelihood of the fitted mixture grows by more than the penalty (half the log of the number of words, times a weight).

Defined results
* ``und``, score 0: null text, text without a letter, or nothing learned. The score is otherwise the proportion of the predicted language.
* Ties go to the language first in alphabetical order. Repeated rows each give a row. Long texts are read whole.
* Rows with null lang or null text teach nothing. ``lang``, ``source`` and ``doc_id`` take no part in a prediction.
* An empty table gives no rows. Extra columns are ignored by ``predict`` and pass through ``keep_known``.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batched, held_out, held_out_id, prepare, rows_of, ship, table

#: Labelled rows per language that the model is fitted on, at most.
SAMPLE_ROWS = 3000
#: Cells that trigrams are hashed into.
CELLS = 1 << 16
SMOOTHING = 0.1
#: Weight of the penalty for each language beyond the first, and the least share of a language in the set.
PENALTY = 4.0
ROUNDS = 30
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")
# the word class of patterns also has numbers that are no digits; the pattern without them is slow, so it only sees words that hold one
_NUMBERS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isnumeric() and not c.isalpha() and not c.isdecimal())
_LETTERS = re.compile(rf"[^\W\d_{re.escape(_NUMBERS)}]+")


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    words = _WORD.findall(text.lower())
    return words if "".join(words).isalpha() else [x for w in words for x in ([w] if w.isalpha() else _LETTERS.findall(w))]


def trigram_cells(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the trigrams of all words (with a blank on both sides), and where each word's trigrams begin."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    cells = (codes[:-2] * 1000003 + codes[1:-1] * 8191 + codes[2:] * 131) % 1000000007 % CELLS
    middle = codes[1:-1] != 32  # a trigram belongs to the word of its middle letter
    blanks = np.flatnonzero(codes == 32)
    # the k-th word has one trigram per letter
    letters = np.diff(blanks) - 1
    return cells[middle], np.concatenate([[0], np.cumsum(letters)[:-1]])


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("cell", pa.int32()), ("n", pa.int64())])
    total: dict[str, np.ndarray] = {}
    for lang, text in rows_of(batches, "lang", "text"):
        cells, _ = trigram_cells(text)
        if lang not in total:
            total[lang] = np.zeros(CELLS, np.int64)
        np.add.at(total[lang], cells, 1)
    for lang, n in total.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], schema=schema)


def learn(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages in alphabetical order and log-probabilities, cells x languages.

    ``docs`` has doc_id, text, lang. Held-out rows are left out. A fixed hash of the row picks the sample, so it does not depend on
    the order of the rows; only ``sample_rows`` per language are read beyond their hash.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return [], np.zeros((CELLS, 0), np.float32)
    # a share of the hash range that holds about sample_rows rows of each language
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, sample_rows / n)))])
    part = F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 30)) / float(1 << 30)
    chosen = labelled.filter(part < F.coalesce(share[F.col("lang")], F.lit(0.0))).select("lang", "text")
    counted = chosen.mapInArrow(_counts, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    found = counted.toPandas()  # languages x cells at most
    langs = sorted(set(sizes) & set(found["lang"]))
    n = np.zeros((CELLS, len(langs)))
    for k, lang in enumerate(langs):
        own = found[found["lang"] == lang]
        n[own["cell"].to_numpy(), k] = own["n"].to_numpy()
    used = max(1, int((n.sum(axis=1) > 0).sum()))
    return langs, np.log((n + SMOOTHING) / (n.sum(axis=0) + SMOOTHING * 2 * used)).astype(np.float32)


def em(likelihood: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Proportions of the mixture and its log-likelihood. ``likelihood``: words x languages, scaled so that each row's best is 1."""
    k = likelihood.shape[1]
    share = np.full(k, 1.0 / k)
    total = weight.sum()
    for _ in range(rounds):
        joint = likelihood * share
        evidence = joint.sum(axis=1)
        new = (joint * (weight / evidence)[:, None]).sum(axis=0) / total
        done = np.abs(new - share).max() < 1e-4
        share = new
        if done:
            break
    return share, float((weight * np.log((likelihood * share).sum(axis=1))).sum())


def mixture(logp: np.ndarray, text: str) -> list[tuple[int, float]]:
    """Languages of the text (their indices) with proportions, largest first; empty if the text has no letter or nothing was learned."""
    cells, starts = trigram_cells(text)
    if not len(cells) or not logp.shape[1]:
        return []
    words = np.add.reduceat(logp[cells], starts, axis=0).astype(np.float64)
    best = words.max(axis=1)
    like = np.exp(np.maximum(words - best[:, None], -60.0))
    weight = np.ones(len(like))
    k = like.shape[1]
    # the languages of the full mixture are tried in the order of their share
    full, _ = em(like, weight) if k > 1 else (np.ones(1), 0.0)
    order = sorted(range(k), key=lambda i: (-full[i], i))
    single = np.log(like).sum(axis=0)
    first = max(order, key=lambda i: (single[i], -i))
    chosen, shares, fit = [first], np.ones(1), float(single[first])
    penalty = PENALTY * 0.5 * np.log(len(like) + 1.0)
    for i in order:
        if i == first:
            continue
        if full[i] < 1.0 / (len(like) + 1.0):
            break
        more, gain = em(like[:, [*chosen, i]], weight)
        if gain - fit <= penalty:
            break
        chosen, shares, fit = [*chosen, i], more, gain
    return sorted(zip(chosen, (float(x) for x in shares)), key=lambda x: (-x[1], x[0]))


_SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, languages string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.string())])


def _predict(langs: list[str], logp: np.ndarray):
    def row(doc_id, text):
        found = mixture(logp, text) if text else []
        if not found:
            return doc_id, held_out_id(doc_id), UNKNOWN, 0.0, ""
        said = ",".join(f"{langs[i]}:{x:.4f}" for i, x in found)
        return doc_id, held_out_id(doc_id), langs[found[0][0]], min(1.0, max(0.0, found[0][1])), said
    return row


ship(__name__)


def predict(docs: DataFrame, langs: list[str], logp: np.ndarray) -> DataFrame:
    """doc_id, held_out, lang_pred, score and the language set with proportions, for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(logp)  # cells x languages, both bounded

    def work(batches):
        row = _predict(langs, shared.value)
        return batched((row(*r) for r in rows_of(batches, "doc_id", "text")), _ARROW)
    return docs.select("doc_id", "text").mapInArrow(work, _SCHEMA)


def keep_known(docs: DataFrame, langs: list[str], logp: np.ndarray) -> DataFrame:
    """Rows of ``docs``, all columns, whose text has a language: rejected are null texts and texts without a letter, also when nothing was
    learned."""
    shared = docs.sparkSession.sparkContext.broadcast(logp)
    at = docs.columns.index("text")

    def work(batches):
        for b in batches:
            keep = pa.array([bool(t) and bool(mixture(shared.value, t) if langs else words_of(t)) for t in b.column(at).to_pylist()], pa.bool_())
            yield b.filter(keep)
    return docs.mapInArrow(work, docs.schema)


def op10_language_mixture(spark: SparkSession, folder: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, folder, "documents", "doc_id", "text", "lang")
    return predict(docs, *learn(docs))
