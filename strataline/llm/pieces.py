"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are compiled from a model file and composed with each input, lazily:

* normaliser: text to symbols (dummy prefix, blanks to the white-space mark, extra blanks removed if the model says so)
* pieces: a trie of the pieces in the order of their scores, with byte fallback: a character that is no piece becomes its UTF-8 bytes
* neighbours: an acceptor over pairs of pieces. A BPE model does not choose the cheapest pieces, it merges by rank. A sequence of
  pieces is what the merges give exactly if every two neighbours are what the merges give for these two alone; the acceptor lets
  only such pairs pass. Its arcs are compiled when they are first needed.

The output is the shortest path in the tropical semiring (costs add along a path, the least cost wins). The cost of a piece is its rank,
that of an arc the acceptor refuses is infinite. For BPE one path of finite cost is left, so the result equals the merges. No piece spans the start of a word
(checked when the model is compiled), so inputs are composed word by word, and words seen before are remembered within a bound.

Decoding is the inverse: pieces to bytes, the mark to a blank, the dummy prefix taken off, invalid UTF-8 replaced.

Defined results
* Null text: null ids and null decoded text. Empty text: no ids. Repeated rows each give a row; extra columns are ignored.
* Control pieces ("<s>") in a text are ordinary text. An empty table gives no rows. Texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_ROWS, kept_in_worker, prepare, rows_of, ship, table

#: Model file; its bytes are read on the driver and broadcast (refused above MOST_BYTES).
MODEL = os.environ.get("STRATALINE_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
MOST_BYTES = 64 << 20
#: Words and neighbour pairs that a task remembers at most.
REMEMBERED = 400_000
MARK = "▁"
#: Costs of an arc that does not exist, and of one that falls back to bytes.
NEVER, BYTES = float("inf"), 1e9
# fixed values of the model file format
BPE, NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 2, 1, 2, 3, 4, 5, 6


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbered fields of one message of the model file."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value
    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = number() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at:at + size]
            at += size


class Model:
    """Pieces, their ranks and the settings of a model file."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        scores, kinds = [], []
        train, norm = {}, {}
        for f, v in fields(data):
            if f == 1:
                p = dict(fields(v))
                self.pieces.append(p[1].decode())
                scores.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
                kinds.append(p.get(3, NORMAL))
            elif f == 2:
                train = dict(fields(v))
            elif f == 3:
                norm = dict(fields(v))
        if train.get(3, 1) != BPE or norm.get(2):
            raise ValueError("only BPE models with the identity normaliser are compiled")
        if any(k in (USER, UNUSED) for k in kinds):
            raise ValueError("user-defined and unused pieces are not supported")
        self.unknown = kinds.index(UNKNOWN)
        self.dummy_prefix, self.squeeze = bool(norm.get(3, 1)), bool(norm.get(4, 1))
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == BYTE} if train.get(35, 0) else {}
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == NORMAL}
        self.cost = {p: -scores[i] for p, i in self.ids.items()}
        by_id = {i: bytes([b]) for b, i in self.bytes.items()}
        by_id |= {i: p.replace(MARK, " ").encode() for p, i in self.ids.items()}
        self.said = [by_id.get(i, " ⁇ ".encode() if i == self.unknown else b"") for i in range(len(self.pieces))]


class Transducer:
    """The compiled machines of one model."""

    def __init__(self, model: Model):
        self.model = model
        self.trie: dict[str, bool] = {}  # every beginning of a piece, and whether it is a whole one
        for p in model.ids:
            for k in range(1, len(p)):
                self.trie.setdefault(p[:k], False)
            self.trie[p] = True
        self.word = self._words()
        self.pairs: dict[str, dict[str, bool]] = {}
        self.arcs = 0
        self.known: dict[str, bytes] = {}

    def _words(self) -> re.Pattern:
        """Cuts that no piece spans: before blanks, and between letters and the rest if the pieces allow it."""
        odd = "".join(sorted({c for p in self.model.ids for c in p if re.match(r"[^\W\d_]", c) and not c.isalpha()}))
        letter = rf"[^\W\d_{re.escape(odd)}]"
        kind = lambda c: 0 if c == MARK else 1 if re.match(letter, c) else 2
        spans = {(kind(a), kind(b)) for p in self.model.ids for a, b in zip(p, p[1:])}
        if (1, 0) in spans or (2, 0) in spans:
            return re.compile(r"(?s).+")
        if (1, 2) in spans or (2, 1) in spans:
            return re.compile(rf"{MARK}*[^{MARK}]+|{MARK}+")
        return re.compile(rf"{MARK}*{letter}+|{MARK}*(?:(?!{letter})[^{MARK}])+|{MARK}+")

    def normalise(self, text: str) -> str:
        if self.model.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        return (MARK if self.model.dummy_prefix else "") + text.replace(" ", MARK)

    def merged(self, text: str) -> list[str]:
        """What merging by rank makes of a short text: the rule that the neighbour acceptor is compiled from."""
        parts, rank = list(text), self.model.cost.get
        while True:
            least, at = NEVER, -1
            for k in range(len(parts) - 1):
                r = rank(parts[k] + parts[k + 1], NEVER)
                if r < least:
                    least, at = r, k
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def _arc(self, last: str, piece: str) -> bool:
        """Compile one arc of the neighbour acceptor."""
        if self.arcs >= REMEMBERED:
            self.pairs.clear()
            self.arcs = 0
        self.arcs += 1
        ok = self.merged(last + piece) == ([last, piece] if last else [piece])
        self.pairs.setdefault(last, {})[piece] = ok
        return ok

    def shortest(self, word: str) -> list[str]:
        """Pieces on the cheapest path through the composition with one word.

        The neighbour acceptor leaves one path to every position (the pieces of a beginning of the word are themselves what the
        merges make of it), so a position that has been reached keeps its state and the costs of other arcs to it are infinite.
        """
        n, trie, pairs, rank = len(word), self.trie, self.pairs, self.model.cost.get
        cost = [NEVER] * (n + 1)  # of the cheapest path to here, the piece that ends it, and where that starts
        last, start = [""] * (n + 1), [0] * (n + 1)
        cost[0] = 0.0
        for i in range(n):
            if cost[i] == NEVER:
                continue
            before = last[i]
            allowed = pairs.get(before)
            if allowed is None:
                allowed = pairs[before] = {}
            j = i + 1
            while j <= n:
                piece = word[i:j]
                whole = trie.get(piece)
                if whole is None and j > i + 1:
                    break
                # a single character that is no piece is an arc too: it falls back to bytes
                if (whole or j == i + 1) and cost[j] == NEVER:
                    ok = allowed.get(piece)
                    if ok is None:
                        ok = self._arc(before, piece)
                        allowed = pairs.setdefault(before, {})
                    if ok:
                        cost[j], last[j], start[j] = cost[i] + rank(piece, BYTES), piece, i
                if whole is None:
                    break
                j += 1
        path, i = [], n
        while i:
            path.append(last[i])
            i = start[i]
        return path[::-1]

    def ids_of(self, word: str) -> bytes:
        out, m = [], self.model
        for p in self.shortest(word):
            i = m.ids.get(p)
            if i is not None:
                out.append(i)
            elif m.bytes:
                out += [m.bytes[b] for b in p.encode("utf-8", "surrogatepass")]
            else:
                out.append(m.unknown)
        return np.array(out, np.int32).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as consecutive 32-bit numbers."""
        words = self.word.findall(self.normalise(text))
        known = self.known
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            pass
        out = []
        for w in words:
            x = known.get(w)
            if x is None:
                x = self.ids_of(w)
                if len(w) <= 40:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[w] = x
            out.append(x)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.model.said.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


def model_bytes(path: str = MODEL) -> bytes:
    if os.path.getsize(path) > MOST_BYTES:
        raise ValueError(f"{path} is larger than {MOST_BYTES} bytes")
    with open(path, "rb") as f:
        return f.read()


_SCHEMA = "doc_id long, ids array<int>, decoded string"


def _ids(parts: list[bytes | None]) -> pa.ListArray:
    ends = np.cumsum([0, *[len(p or b"") // 4 for p in parts]]).astype(np.int32)
    flat = pa.array(np.frombuffer(b"".join(p or b"" for p in parts), np.int32))
    return pa.ListArray.from_arrays(pa.array(ends), flat, mask=pa.array([p is None for p in parts]))


ship(__name__)


def encode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, ids, and the text decoded from the ids, for every row."""
    model = model_bytes(path)
    shared, digest = docs.sparkSession.sparkContext.broadcast(model), hashlib.sha256(model).hexdigest()

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = kept_in_worker(("pieces", digest), lambda: Transducer(Model(shared.value)))
        schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
        for b in batches:
            for k in range(0, b.num_rows, BATCH_ROWS):
                doc, text = zip(*rows_of([b.slice(k, BATCH_ROWS)], "doc_id", "text"))
                ids = [None if x is None else t.encode(x) for x in text]
                back = [None if x is None else t.decode(np.frombuffer(x, np.int32)) for x in ids]
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), _ids(ids).cast(schema.field("ids").type), pa.array(back, pa.string())], schema=schema)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(work, _SCHEMA)




def with_digests(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """Ids, their number, and the digest of the text decoded from them."""
    return encode(docs, path).select(
        "doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("bigint").alias("n_tokens"), "ids",
        F.sha2(F.coalesce("decoded", F.lit("")), 256).alias("decoded_sha256"))


def op4_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    prepare(spark)
    return with_digests(table(spark, folder, "documents", "doc_id", "text"))
