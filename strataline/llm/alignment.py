"""Alignment of two tokenizers over the same text, by galloping intersection of their token ends.

A is a byte-level BPE, B a SentencePiece BPE that puts a blank before the text. Both give byte ranges over blank + text. The ends of the shorter list are
looked up in the longer one: from the last match on, steps double until they pass the end (exponential search), then a binary search
finds it in the last step. Ends that occur in both lists cut the text into groups; the differences of their ranks give the range of A and of B
tokens that each group overlaps. A link is a pair of tokens that end together.

Text is cut at single blanks between two characters that are no white space. Neither tokenizer has a token across such a place (checked for the
pieces when a model is loaded; the byte-level splitter begins a word there), so every part is tokenized on its own, ends there are
common ends, and the alignment of a text is that of its parts one after another. Parts seen before are remembered within a bound.

How it runs: one pass over the texts writes the figures of each text and its different linked pairs with their numbers. Corpus counts come from
these rows; equal pairs combine before the shuffle. The rows then look their pairs up: the ``MOST_PAIRS`` most frequent ones are sent to the
tasks, the others go through a join (see ``lookup``). Texts are read once and never shuffled; very long ones are worked off in slices.

Defined results
* Null, empty: no tokens. So are texts whose joined token bytes differ from blank + text (a text with the white-space mark U+2581).
* Special token strings are ordinary text. Repeated rows each give a row (and count as often). Extra columns are ignored.
* Ties: every pair that reaches the highest count of its B id is best. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import pickle
import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from .blockmax import ranges
from .common import batched, kept_in_worker, prepare, rows_of, share, ship, table
from .lookup import Numbers, frequent
from .pieces import BYTE, MARK, fields, model_bytes

TOKENIZERS = os.environ.get("STRATALINE_TOKENIZERS", "/opt/tokenizers")
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs of ids whose figures are sent to every task; links of the others are joined.
MOST_PAIRS = 1 << 19
#: Parts that a worker remembers, and the characters it works on at a time.
REMEMBERED = 400_000
SLICE = 1 << 20

#: Fixed values of the byte-level vocabulary: its word pattern and its special token.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = ("<|endoftext|>",)

_CUT = re.compile(r"(?<=\S) (?=\S)")


def gallop(short: np.ndarray, long: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Place in the ascending ``long`` of each number of ``short``, or -1. No number lies before its ``start``. All numbers take their steps at
    the same time: steps double until they pass the number (exponential search), then a binary search in the last step finds it."""
    n = len(long)
    if not n:
        return np.full(len(short), -1)
    low, at, step = start.copy(), start.copy(), 1
    left = np.flatnonzero(at < n)
    while len(left):
        left = left[long[at[left]] < short[left]]
        low[left] = at[left] + 1
        at[left] += step
        step *= 2
        left = left[at[left] < n]
    high = np.minimum(at, n)
    left = np.flatnonzero(low < high)
    while len(left):
        mid = (low[left] + high[left]) // 2
        below = long[mid] < short[left]
        low[left] = np.where(below, mid + 1, low[left])
        high[left] = np.where(below, high[left], mid)
        left = left[low[left] < high[left]]
    low = np.minimum(low, n - 1)
    return np.where(long[low] == short, low, -1)


def common_ends(a: np.ndarray, b: np.ndarray, a_size: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b of every end that both have. ``a`` and ``b`` hold the ends of many texts one after another (counted on from text to
    text), ``a_size`` and ``b_size`` how many belong to each text; in each text the shorter list drives."""
    out = []
    for x, y, x_size, y_size, drives in ((a, b, a_size, b_size, a_size <= b_size), (b, a, b_size, a_size, a_size > b_size)):
        own = np.flatnonzero(np.repeat(drives, x_size))
        place = gallop(x[own], y, np.repeat((np.cumsum(y_size) - y_size)[drives], x_size[drives]))
        hit = place >= 0
        out.append((own[hit], place[hit]))
    (xa, xb), (yb, ya) = out
    at_a, at_b = np.concatenate([xa, ya]), np.concatenate([xb, yb])
    order = np.argsort(at_a, kind="stable")
    return at_a[order], at_b[order]


def byte_level_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed values of the vocabulary format
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(c): b for b, c in [*zip(own, own), *zip(rest, range(256, 256 + len(rest)))]}


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """The text cut at places between parts, each slice about ``size`` characters long; the blanks at the cuts are left out."""
    at = 0
    while len(text) - at > size:
        m = _CUT.search(text, at + size)
        if not m:
            break
        yield text[at:m.start()]
        at = m.end()
    yield text[at:] if at else text


class Aligner:
    """Both tokenizers and the alignments of the parts seen so far, as arrays."""

    def __init__(self, byte_level: bytes, pieces: bytes, remembered: int = REMEMBERED):
        import sentencepiece
        import tiktoken
        self.b = sentencepiece.SentencePieceProcessor()
        self.b.LoadFromSerializedProto(pieces)
        known = byte_level_alphabet()
        vocabulary = json.loads(byte_level)["model"]["vocab"]
        said = {i: bytes(known[c] for c in t) for t, i in vocabulary.items() if all(c in known for c in t) and t not in SPECIAL}
        self.a_bytes = [said.get(i, b"") for i in range(max(said) + 1)]
        # the ids of this vocabulary are the ranks of its merges; special tokens are left out, so their strings are ordinary text
        self.a = tiktoken.Encoding("bytes", pat_str=WORDS, mergeable_ranks={t: i for i, t in said.items()}, special_tokens={})
        names, kinds = [], []
        for f, v in fields(pieces):
            if f == 1:
                p = dict(fields(v))
                names.append(p[1].decode())
                kinds.append(p.get(3, 1))
        if any(MARK in p.lstrip(MARK) for p in names):
            raise ValueError("a piece spans the beginning of a word")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, k in zip(names, kinds)]
        self.a_size, self.b_size = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        # every id as text, followed by each mark that can follow it
        self.marked = np.array([f"{i}{mark}" for mark in (",", "|", ";") for i in range(max(len(self.a_bytes), len(self.b_bytes)))], object)
        self.most = remembered
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.text: list[str] = []
        self.n = np.zeros((3, 1024), np.int64)  # A tokens, B tokens, groups
        self.bad = np.zeros(1024, bool)
        self.at, self.pairs = np.zeros(1025, np.int64), np.zeros(4096, np.int64)

    def tokens(self, parts: list[str]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
        """Ids of A and of B for each part, and whether the bytes of both are those of blank + part (else without ids)."""
        encode = self.a.encode_ordinary
        a = [encode(" " + p) for p in parts]
        b = self.b.encode(parts, num_threads=1)
        a_said, b_said = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        good = np.ones(len(parts), bool)
        whole = " " + " ".join(parts)
        if b"".join([a_said(i) for x in a for i in x]) != whole.encode("utf-8", "surrogatepass") or b"".join([b_said(i) for x in b for i in x]) != whole.encode("utf-8", "surrogatepass"):
            for k, p in enumerate(parts):
                want = (" " + p).encode("utf-8", "surrogatepass")
                if b"".join(map(a_said, a[k])) != want or b"".join(map(b_said, b[k])) != want:
                    a[k], b[k], good[k] = [], [], False
        return a, b, good

    def add(self, parts: list[str]) -> None:
        """Align parts that are not known yet."""
        a, b, good = self.tokens(parts)
        a_size, b_size = (np.fromiter(map(len, x), np.int64, len(parts)) for x in (a, b))
        a_ids, b_ids = (np.fromiter((i for y in x for i in y), np.int64, int(size.sum())) for x, size in ((a, a_size), (b, b_size)))
        # good parts have the same bytes in both, so their ends can be counted on from part to part
        at_a, at_b = common_ends(np.cumsum(self.a_size[a_ids]), np.cumsum(self.b_size[b_ids]), a_size, b_size)
        pairs = a_ids[at_a] << 32 | b_ids[at_b]
        part_ends = np.cumsum(a_size)
        group_part = np.searchsorted(part_ends, at_a, side="right")
        links = np.bincount(group_part, minlength=len(parts))
        # the tokens in the order in which they are written: group by group, those of A before those of B
        a_group, b_group = np.searchsorted(at_a, np.arange(len(a_ids))), np.searchsorted(at_b, np.arange(len(b_ids)))
        order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        mark = np.zeros(len(a_ids) + len(b_ids), np.int64)
        mark[at_a], mark[len(a_ids) + at_b] = 1, 2
        written = self.marked[(mark * (len(self.marked) // 3) + np.concatenate([a_ids, b_ids]))[order]].tolist()
        ends = np.cumsum(a_size + b_size).tolist()
        first, need = len(self.text), len(self.text) + len(parts)
        while need > self.n.shape[1]:
            self.n = np.concatenate([self.n, np.zeros_like(self.n)], axis=1)
            self.bad = np.concatenate([self.bad, np.zeros_like(self.bad)])
            self.at = np.concatenate([self.at, np.zeros(len(self.at) - 1, np.int64)])
        self.index.update(zip(parts, range(first, need)))
        self.text += ["".join(written[i:j])[:-1] for i, j in zip([0, *ends], ends)]
        self.bad[first:need] = ~good
        self.n[:, first:need] = a_size, b_size, links
        start = int(self.at[first])
        self.at[first + 1:need + 1] = start + np.cumsum(links)
        while start + len(pairs) > len(self.pairs):
            self.pairs = np.concatenate([self.pairs, np.zeros_like(self.pairs)])
        self.pairs[start:start + len(pairs)] = pairs

    def places(self, units: list[str]) -> list[np.ndarray]:
        """Numbers of the parts of each slice of text."""
        split = [_CUT.split(u) for u in units]
        new = list(dict.fromkeys(p for s in split for p in s if p not in self.index))
        if len(self.text) + len(new) > self.most:
            self.forget()
            new = list(dict.fromkeys(p for s in split for p in s))
        for k in range(0, len(new), 8192):
            self.add(new[k:k + 8192])
        get = self.index.__getitem__
        return [np.fromiter(map(get, s), np.int64, len(s)) for s in split]

    def pairs_of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Different linked pairs of these parts, and how often they are linked."""
        size = self.at[places + 1] - self.at[places]
        return np.unique(self.pairs[ranges(self.at[places], size)], return_counts=True)


def _units(batches: Iterable[pa.RecordBatch], *columns: str) -> Iterator[list[tuple[int, tuple, list[str]]]]:
    """Groups of (row number, row, slices of its text) of about ``SLICE`` characters; a longer text is a group of its own."""
    held, size, n = [], 0, 0
    for row in rows_of(batches, *columns):
        held.append((n, row, row[-1] or ""))
        size += len(row[-1] or "")
        n += 1
        if size > SLICE:
            yield held
            held, size = [], 0
    if held:
        yield held


def aligned(aligner: Aligner, batches: Iterable[pa.RecordBatch], *columns: str) -> Iterator[tuple[tuple, bool, list[np.ndarray]]]:
    """(row, whether the bytes come back, part numbers) of each text, slice by slice: the last column is the text. A text of several slices is read
    twice: first to see whether all its bytes come back."""
    for group in _units(batches, *columns):
        if len(group) == 1 and len(group[0][2]) > SLICE:
            _, row, text = group[0]
            good = all(not aligner.bad[aligner.places([s])[0]].any() for s in slices(text))
            yield row, good, (aligner.places([s])[0] for s in slices(text)) if good else ()
            continue
        texts = [t for _, _, t in group if t]
        places = iter(aligner.places(texts) if texts else [])
        for _, row, text in group:
            at = next(places) if text else None
            good = at is not None and not aligner.bad[at].any()
            yield row, good, (at,) if good else ()


_TEXTS = pa.schema([("doc_id", pa.int64()), ("ka", pa.int64()), ("kb", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups")], ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary())])
_TEXTS_DDL = "doc_id long, ka long, kb long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs binary, times binary"
_PAIRS = pa.schema([("pair", pa.int64()), ("n", pa.int64())])
_ROWS = pa.schema([*[_TEXTS.field(k) for k in range(7)], ("n_best", pa.int64()), ("count_sum", pa.int64()), ("pair", pa.int64()), ("n", pa.int64())])
_ROWS_DDL = _TEXTS_DDL.split(", pairs")[0] + ", n_best long, count_sum long, pair long, n long"

ship(__name__)


def summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs of several lists of (pairs, numbers), and the sums of their numbers."""
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs, own = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
    return pairs, np.bincount(own, np.concatenate([n for _, n in held]), len(pairs)).astype(np.int64)


def align_texts(docs: DataFrame, folder: str = TOKENIZERS, remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, a key of the text, token and group figures, and the linked pairs (as 64-bit numbers, A id * 2**32 + B id) with their numbers (32 bits) of every text."""
    files = model_bytes(f"{folder}/{BYTE_LEVEL}"), model_bytes(f"{folder}/{PIECES}")
    shared, digest = docs.sparkSession.sparkContext.broadcast(files), hashlib.sha256(files[0] + files[1]).hexdigest()

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = kept_in_worker(("alignment", digest, remembered), lambda: Aligner(*shared.value, remembered=remembered))

        def row(doc, text, good, parts):
            if not good:
                return doc, 0, 0, 0, 0, 0, "", b"", b""
            said = xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))
            total, sha, held, mark = np.zeros(3, np.int64), hashlib.sha256(), [], b""
            for at in parts:
                total += aligner.n[:, at].sum(axis=1)
                sha.update(mark + ";".join([aligner.text[k] for k in at.tolist()]).encode())
                held.append(aligner.pairs_of(at))
                mark = b";"
            pairs, times = summed(held)
            return (doc, *(int.from_bytes(said[k:k + 8], "big", signed=True) for k in (0, 8)), *total.tolist(), sha.hexdigest(), pairs.tobytes(), times.astype(np.int32).tobytes())
        return batched((row(*r, good, parts) for r, good, parts in aligned(aligner, batches, "doc_id", "text")), _TEXTS)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(work, _TEXTS_DDL)


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs and numbers of a batch of texts, and the places of the texts they come from."""
    pairs, times = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("pairs", "times"))
    own = np.repeat(np.arange(b.num_rows), np.array([len(t) // 4 for t in times], np.int64))
    return np.frombuffer(b"".join(pairs), np.int64), np.frombuffer(b"".join(times), np.int32).astype(np.int64), own


def link_counts(texts: DataFrame) -> DataFrame:
    """pair and how many links of the corpus hold it, for every pair that is linked."""
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(_flat(b)[:2])
            size += len(held[-1][0])
            if size > 1 << 21:
                held = [summed(held)]
                size = len(held[0][0])
                if size > 1 << 20:  # handed on as it does not combine any more
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, held[0])), schema=_PAIRS)
                    held, size = [], 0
        yield pa.RecordBatch.from_arrays(list(map(pa.array, summed(held))), schema=_PAIRS)
    return texts.select("pairs", "times").mapInArrow(work, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, folder: str = TOKENIZERS, most_pairs: int = MOST_PAIRS, remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, token, group and link figures of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    texts = materialise(align_texts(docs, folder, remembered))
    counts = materialise(link_counts(texts))
    b_id = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    # one row for each id of B: its vocabulary bounds it
    highest = counts.groupBy(b_id.alias("b")).agg(F.max("n").alias("most"))
    counts = materialise(counts.withColumn("b_id", b_id).join(highest, F.col("b_id") == F.col("b")).select("pair", F.col("n").alias("links"), (F.col("n") == F.col("most")).alias("best")))
    top = frequent(counts, "links", most_pairs).toArrow()
    figures, name = share(spark, tuple(top.column(c).to_numpy() for c in ("pair", "links", "best"))), uuid.uuid4().hex

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make():
            pair, links, best = pickle.loads(figures.value)
            return Numbers(pair), np.append(links, 0), np.append(best, False).astype(np.int64)
        numbers, links, best = kept_in_worker(("pairs", name), make)
        for b in batches:
            pairs, times, own = _flat(b)
            at = numbers.find(pairs)  # -1, the appended zero, where a pair has no figures here
            n_best, count_sum = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            np.add.at(n_best, own, times * best[at])
            np.add.at(count_sum, own, times * links[at])
            none = pa.nulls(b.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:7], pa.array(n_best), pa.array(count_sum), none, none], schema=_ROWS)
            rest = np.flatnonzero(at < 0)
            if len(rest):
                keys = b.select(["ka", "kb"]).take(pa.array(own[rest]))
                blank = {f.name: pa.nulls(len(rest), f.type) for f in _ROWS}
                blank |= {"ka": keys.column(0), "kb": keys.column(1), "pair": pa.array(pairs[rest]), "n": pa.array(times[rest])}
                yield pa.RecordBatch.from_arrays(list(blank.values()), schema=_ROWS)
    found = materialise(texts.mapInArrow(work, _ROWS_DDL))
    rows, rest = found.filter(F.col("pair").isNull()).drop("pair", "n"), found.filter(F.col("pair").isNotNull())
    # links of pairs without figures in the tasks; a text that several rows have has them several times
    more = rest.select("ka", "kb", F.col("pair").alias("__pair"), "n").join(counts, F.col("__pair") == F.col("pair"))
    more = more.groupBy("ka", "kb").agg(F.sum(F.col("n") * F.col("best").cast("bigint")).alias("more_best"), F.sum(F.col("n") * F.col("links")).alias("more_sum"), F.lit(0).cast("bigint").alias("rows"))
    times = rows.groupBy("ka", "kb").agg(F.lit(0).cast("bigint").alias("more_best"), F.lit(0).cast("bigint").alias("more_sum"), F.count(F.lit(1)).alias("rows"))
    more = more.unionByName(times).groupBy("ka", "kb").agg(*[F.sum(c).alias(c) for c in ("more_best", "more_sum", "rows")]).filter("more_sum > 0")
    # dealt by a hash of its own, so that a text on a third of all rows can be split
    more = more.select(F.xxhash64("ka", "kb").alias("key"), F.col("ka").alias("a"), F.col("kb").alias("b"), F.expr("more_best div rows").alias("more_best"), F.expr("more_sum div rows").alias("more_sum"))
    out = rows.withColumn("own", F.xxhash64("ka", "kb")).join(more, (F.col("own") == F.col("key")) & (F.col("ka") == F.col("a")) & (F.col("kb") == F.col("b")), "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), *[(F.col(c) + F.coalesce(x, F.lit(0))).alias(c) for c, x in (("n_best", "more_best"), ("count_sum", "more_sum"))], "groups_sha256")


def op13_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    prepare(spark)
    return align(table(spark, folder, "documents", "doc_id", "text"))
