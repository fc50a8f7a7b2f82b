"""Document fingerprints from prefix polynomial hashes.

For a text c[0..n), the modular prefix array H[i] = sum over j < i of (c[j] + 1) * B^j (mod p) answers the equality of any two spans in
O(1) after aligning their powers, and the longest common extension of two positions by binary search. Two primes below 2^31 back
the span tests; a third widens the fingerprint of the whole text, which also names the length.

Likeness of two texts: the code points covered by their longest common prefix and (not overlapping it) longest common suffix, over
the length of the longer one. Two empty texts have likeness 1.

Defined results
* Null text counts as empty. Equal texts have equal fingerprints.
* "Next" follows descending doc_id, nulls last; rows with one doc_id are ordered by text, descending. After the last comes the first.
* Repeated rows each give a row. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batched, prepare, rows_of, ship, table

#: Fixed primes below 2^31 (so that products of two residues fit in 64 bits) and bases.
PRIMES = (2147483647, 2147483629, 2147483587)
BASES = (911382323, 972663749, 1000003)
#: Most pieces that the ordered walk is cut into; their first ids travel inside the plan.
MOST_PIECES = 4096

_powers: list[np.ndarray] = [np.ones(1, np.uint64) for _ in PRIMES]


def powers(k: int, n: int) -> np.ndarray:
    """B^0 .. B^(n-1) mod p of modulus k; the table doubles as needed."""
    t = _powers[k]
    while len(t) < n:
        step = np.uint64(int(t[-1]) * BASES[k] % PRIMES[k])
        t = np.concatenate([t, t * step % np.uint64(PRIMES[k])])
    _powers[k] = t
    return t[:n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


class Prefixes:
    """Prefix arrays of one text under the three moduli."""

    __slots__ = ("n", "sums")

    def __init__(self, n: int, sums: list[np.ndarray]):
        self.n, self.sums = n, sums

    @classmethod
    def of(cls, text: str) -> Prefixes:
        codes = code_points(text) + np.uint64(1)
        sums = []
        for k, p in enumerate(PRIMES):
            h = np.zeros(len(codes) + 1, np.uint64)
            np.cumsum(codes * powers(k, len(codes)) % np.uint64(p), out=h[1:])
            sums.append(h % np.uint64(p))
        return cls(len(codes), sums)

    def spliced(self, keep: int, other: Prefixes, take: int) -> Prefixes:
        """Prefix arrays of self[:keep] + other[:take], from the two arrays alone."""
        sums = []
        for k, p in enumerate(PRIMES):
            shift = np.uint64(int(powers(k, keep + 1)[keep]))
            tail = (other.sums[k][1:take + 1] * shift % np.uint64(p) + self.sums[k][keep]) % np.uint64(p)
            sums.append(np.concatenate([self.sums[k][:keep + 1], tail]))
        return Prefixes(keep + take, sums)

    def fingerprint(self) -> str:
        return f"{self.n:x}-" + "".join(f"{int(s[-1]):08x}" for s in self.sums)


def same_span(a: Prefixes, i: int, b: Prefixes, j: int, length: int) -> bool:
    """Is a[i : i + length] equal to b[j : j + length]?"""
    for k in (0, 1):
        p, s, t = PRIMES[k], a.sums[k], b.sums[k]
        x, y = int(s[i + length]) - int(s[i]), int(t[j + length]) - int(t[j])
        if i < j:
            x *= int(powers(k, j - i + 1)[j - i])
        elif j < i:
            y *= int(powers(k, i - j + 1)[i - j])
        if (x - y) % p:
            return False
    return True


def common_prefix(a: Prefixes, i: int, b: Prefixes, j: int) -> int:
    """Longest common extension to the right of a[i:] and b[j:], by doubling and binary search."""
    return _search(min(a.n - i, b.n - j), lambda m: same_span(a, i, b, j, m))


def common_suffix(a: Prefixes, i: int, b: Prefixes, j: int) -> int:
    """Longest common extension to the left of a[:i] and b[:j]."""
    return _search(min(i, j), lambda m: same_span(a, i - m, b, j - m, m))


def _search(most: int, same) -> int:
    low, high = 0, 1
    while high <= most and same(high):
        low, high = high, high * 2
    high = min(high, most + 1)
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if same(mid) else (low, mid)
    return low


def likeness(a: Prefixes, b: Prefixes) -> float:
    if a.n == b.n == 0:
        return 1.0
    head = common_prefix(a, 0, b, 0)
    tail = min(common_suffix(a, a.n, b, b.n), min(a.n, b.n) - head)
    return (head + tail) / max(a.n, b.n)


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted within their piece; after a piece's own rows comes the first row of the next piece."""
    def results():
        held = None
        for piece, own, doc_id, text in rows_of(batches, "piece", "own", "doc_id", "text"):
            now = (piece, own, doc_id, text, Prefixes.of(text))
            if held is not None and held[1] and held[0] == piece:
                yield compare(held, now)
            held = now

    def compare(a: tuple, b: tuple) -> tuple:
        keep = a[4].n - a[4].n // 2
        take = min(a[4].n // 2, b[4].n)
        edited = a[4].spliced(keep, b[4], take)
        digest = hashlib.sha256((a[3][:keep] + b[3][:take]).encode("utf-8", "surrogatepass")).hexdigest()
        return a[2], a[4].n, digest, a[4].fingerprint(), edited.fingerprint(), likeness(a[4], edited), likeness(a[4], b[4])

    return batched(results(), _ARROW)


ship(__name__)


def with_next(docs: DataFrame, pieces: int | None = None) -> DataFrame:
    """Pieces of the descending order by doc_id: piece, own, doc_id, text.

    The first ids of the pieces are values of the column itself (quantiles of the ids alone); a row that opens a piece is also sent,
    as not own, to the end of the piece before it. One shuffle of the texts, whatever the number of pieces.
    """
    spark = docs.sparkSession
    pieces = min(pieces or 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_PIECES)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("said"))
    steps = [i / pieces for i in range(1, pieces)]
    top, found = docs.agg(F.max("id"), F.percentile_approx("id", steps) if steps else F.lit(None)).head()
    cuts = sorted({c for c in found or []}, reverse=True)
    doc_id = F.col("id")
    last = len(cuts)
    marks = F.array(*[F.lit(c).cast("bigint") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    piece = F.when(doc_id.isNull(), F.lit(last)).otherwise(F.size(F.filter(marks, lambda c: c >= doc_id)))
    first = F.when(doc_id.eqNullSafe(F.lit(top).cast("bigint")), F.lit(last)).otherwise(
        F.when(F.array_contains(marks, doc_id), piece - 1))
    # the first id of all may also be a cut; then it opens two pieces
    places = F.array(F.struct(piece.alias("piece"), F.lit(True).alias("own")), F.struct(first.alias("piece"), F.lit(False).alias("own")))
    sent = docs.select("id", "said", F.explode(F.filter(places, lambda x: x["piece"].isNotNull())).alias("at"))
    sent = sent.select("at.piece", "at.own", F.col("id").alias("doc_id"), F.col("said").alias("text"))
    return sent.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "piece").sortWithinPartitions(
        "piece", F.desc("own"), F.desc_nulls_last("doc_id"), F.desc("text"))


def fingerprints(docs: DataFrame, pieces: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness (see the columns of ``op2``)."""
    return with_next(docs, pieces).mapInArrow(_walk, _SCHEMA)


def op2_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    prepare(spark)
    return fingerprints(table(spark, folder, "documents", "doc_id", "text"))
