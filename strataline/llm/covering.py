"""SimHash near-dedup with anchor points of a covering code.

A fingerprint has 64 bits over the XXH64 values of all 3-word shingles (see ``fingerprint``); fingerprints link at 3 or fewer differing bits.
The links are found for fingerprints of one or two 64-bit numbers (at 7 bits then), made of 32-bit parts.

Anchors: of two fingerprints that differ in 3 bits or fewer of 64 (7 of 128), one 32-bit part differs in 1 bit or none. On 31 bits of
each part the anchors are the words of the perfect Hamming code (covering radius 1): every part lies within 1 of its home anchor. A
fingerprint is replicated to every anchor within covering radius plus threshold of its part (1 + 1), that is 16 anchors or 1; a partner
whose part differs in 1 bit lies within 2 of the home anchor of the other, so the two meet there. Fingerprints are compared per anchor
over all bits, which makes the links exact.

Only distinct fingerprints are replicated (copies are one class), a fixed 16 rows for each part. Within an anchor only a spanning forest of the
links is kept, never all pairs: links meet again as connected components. An anchor with more than ``LARGEST`` fingerprints is dealt to
several tasks by pairs of parts, so its comparisons are spread and no task holds more than two parts.

Defined results
* Null text counts as empty. No words: fingerprint zero, linked like any other.
* component_id is the smallest doc_id that can be reached; null doc_ids do not count, a component of null doc_ids has a null id.
* Repeated rows each give a row. Extra columns are ignored by ``near_classes`` and pass through ``keep_one``. Empty tables give no rows.
* ``keep_one`` keeps one row of every component: the smallest doc_id (null ids last), ties by a hash of the row. Rows that share a doc_id, or
  have none, are told apart by their content, so no text goes unless one of its component stays. Very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from .common import by_marks, prepare, row_key, rows_of, ship, table
from .components import components, follow

#: A fingerprint of n 64-bit numbers links at 4 n - 1 differing bits: then one of its 2 n parts differs in at most 1.
BITS = {1: 3, 2: 7}
WORDS = 3
LAST = (1 << 63) - 1
#: Fingerprints of one anchor that one task compares; larger anchors are dealt out by pairs of parts.
LARGEST = 8192
#: Rows that a task compares at a time (whole anchors).
CHUNK = 400_000
_LOW = np.uint64(0x7FFFFFFF)
#: Masks of the five parity checks of the Hamming code of length 31 (positions 1 to 31).
_CHECKS = [np.uint64(sum(1 << (i - 1) for i in range(1, 32) if i >> j & 1)) for j in range(5)]


def fingerprint(text: str | None) -> int:
    """Lower-cased (A-Z) words between ASCII white space, shingles of 3 words with repeats (all words if fewer), XXH64 with seed 42; a
    bit is set if it is set in more than half of the hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    said = b" ".join(words)
    if len(words) <= WORDS:
        return xxhash.xxh64_intdigest(said, 42)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))).tolist()
    starts = [0, *[e + 1 for e in ends[:-WORDS]]]
    digest = xxhash.xxh64_digest
    votes, total = np.zeros(64, np.int64), len(starts)
    for k in range(0, total, 65536):
        part = b"".join([digest(said[a:b], 42) for a, b in zip(starts[k:k + 65536], ends[WORDS - 1 + k:WORDS - 1 + k + 65536])])
        votes += np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > total).tobytes(), "big")


def node_of(fp: list[np.ndarray]) -> np.ndarray:
    """One 64-bit name for a fingerprint: itself, or a hash of both halves."""
    if len(fp) == 1:
        return fp[0]
    x = (fp[0] * np.uint64(0x9E3779B97F4A7C15)) ^ (fp[1] + np.uint64(0x7F4A7C15))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32)) ^ fp[1]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def syndrome(half: np.ndarray) -> np.ndarray:
    """Exclusive or of the positions of the set bits: 0 for a code word, else the position that leads to the home anchor."""
    s = np.zeros(len(half), np.uint64)
    for j, m in enumerate(_CHECKS):
        s |= (np.bitwise_count(half & m).astype(np.uint64) & np.uint64(1)) << np.uint64(j)
    return s


def anchors(fp: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(index into the fingerprints, anchor) of every anchor within 2 of a part. ``fp``: one array for each 64 bits."""
    at, out = [], []
    one = np.uint64(1)
    index = np.arange(len(fp[0]))
    for h in range(2 * len(fp)):
        half = fp[h // 2] >> np.uint64(32 * (h % 2)) & _LOW
        s = syndrome(half)
        mark = np.uint64(h << 31)
        home = np.where(s > 0, half ^ (one << (np.maximum(s, one) - one)), half)
        at.append(index)
        out.append(home | mark)
        for i in range(1, 32):
            j = np.uint64(i) ^ s
            two = (s > 0) & (j > np.uint64(i))  # flips of positions i and j that end in a code word
            at.append(index[two])
            out.append((half[two] ^ (one << np.uint64(i - 1)) ^ (one << (j[two] - one))) | mark)
    return np.concatenate(at), np.concatenate(out)


_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first columns as they are, and the fingerprint of the last one."""
    for b in batches:
        fp = np.array([fingerprint(t) for (t,) in rows_of([b], b.schema.names[-1])], np.uint64)
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp.view(np.int64))], names=[*b.schema.names[:-1], "fp"])


def _unsigned(b: pa.RecordBatch, first: int) -> list[np.ndarray]:
    return [b.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(first, b.num_columns)]


def _place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = _unsigned(b, 0)
        at, anchor = anchors(fp)
        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (anchor, *[f[at] for f in fp])], names=["anchor", *b.schema.names])


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star per component of the edges: every node but the smallest with the smallest."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[:len(u)], ends[len(u):]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        np.minimum.at(new, label[a], new[a])
        np.minimum.at(new, label[b], new[b])
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def differing(a: list[np.ndarray], b: list) -> np.ndarray:
    return sum(np.bitwise_count(x ^ y).astype(np.int16) for x, y in zip(a, b))


def _dense(fp: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links in one large anchor: breadth first, each fingerprint is expanded once against those not reached."""
    node, bits = node_of(fp), BITS[len(fp)]
    left, u, v = np.arange(len(node)), [], []
    while len(left):
        root, left, front = left[0], left[1:], left[:1]
        while len(front) and len(left):
            step, front = front[:256], front[256:]
            rest = [f[left] for f in fp]
            near = np.zeros(len(left), bool)
            for k in step:
                near |= differing(rest, [f[k] for f in fp]) <= bits
            new, left = left[near], left[~near]
            u.append(node[new])
            v.append(np.full(len(new), node[root]))
            front = np.concatenate([front, new])
    return (np.concatenate(u), np.concatenate(v)) if u else (node[:0], node[:0])


def links(anchor: np.ndarray, fp: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links within the anchors; rows sorted by anchor, no fingerprint twice at one anchor."""
    node, bits = node_of(fp), BITS[len(fp)]
    starts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(anchor)]]))
    u, v = [], []
    small = np.repeat(sizes <= 48, sizes)
    for shift in range(1, int(min(48, sizes.max(initial=1)))):
        a = np.flatnonzero(small[:-shift] & (anchor[:-shift] == anchor[shift:]))
        a = a[differing([f[a] for f in fp], [f[a + shift] for f in fp]) <= bits]
        if len(a):
            # the same two fingerprints meet at many anchors
            x, y = node[a], node[a + shift]
            x, y = forest(np.minimum(x, y), np.maximum(x, y))
            u.append(x)
            v.append(y)
    for k in np.flatnonzero(sizes > 48):
        x, y = _dense([f[starts[k]:starts[k] + sizes[k]] for f in fp])
        u.append(x)
        v.append(y)
    if not u:
        return node[:0], node[:0]
    u, v = np.concatenate(u), np.concatenate(v)
    keep = u != v
    return forest(u[keep], v[keep])


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor (and part); whole anchors are compared about ``CHUNK`` rows at a time."""
    def edges(anchor, fp):
        u, v = links(anchor, fp)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], schema=_EDGES)

    held_a, held_f, n = [], [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held_a.append(b.column(0).to_numpy(zero_copy_only=False))
        held_f.append(_unsigned(b, 1))
        n += b.num_rows
        if n >= CHUNK:
            anchor, fp = np.concatenate(held_a), [np.concatenate(x) for x in zip(*held_f)]
            done = int(np.searchsorted(anchor, anchor[-1]))
            if done:
                yield edges(anchor[:done], [f[:done] for f in fp])
            held_a, held_f, n = [anchor[done:]], [[f[done:] for f in fp]], len(anchor) - done
    if n:
        yield edges(np.concatenate(held_a), [np.concatenate(x) for x in zip(*held_f)])


ship(__name__)


def fingerprint_table(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the columns ``more`` and fp (as a signed 64-bit number), written to the shared folder: texts are read once."""
    kinds = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in more)
    return materialise(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *more, "text").mapInArrow(_fingerprints, f"doc_id long, {kinds}fp long"))


def link_edges(fps: DataFrame, largest: int = LARGEST) -> DataFrame:
    """Edges (u, v) that connect the same fingerprints as all links do. ``fps``: distinct rows of one or two 64-bit numbers; the ends
    of an edge are their names (see ``node_of``)."""
    spark, parts_of = fps.sparkSession, fps.columns
    placed = fps.mapInArrow(_place, "anchor long, " + ", ".join(f"{c} long" for c in parts_of))
    crowded = placed.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > largest)
    crowded = materialise(crowded.withColumn("parts", F.ceil(F.col("n") * 2 / largest).cast("int")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = placed.withColumn("part", F.lit(0).cast("bigint"))
    if not crowded.isEmpty():
        # a crowded anchor becomes one group per pair of parts: every two of its fingerprints meet in one of them
        hot = crowded.select(F.col("anchor").alias("hot"), "parts")
        both = placed.join(hot, F.col("anchor") == F.col("hot"), "left")
        mine = F.pmod(F.xxhash64(*parts_of), F.col("parts")).cast("int")
        other = F.sequence(F.lit(0), F.col("parts") - 1)
        pairs = F.transform(other, lambda o: F.least(o, mine).cast("bigint") * F.col("parts") + F.greatest(o, mine))
        plain = both.withColumn("part", F.explode(F.coalesce(pairs, F.array(F.lit(0).cast("bigint"))))).drop("hot", "parts")
    # one sort key for anchor and part: parts of an anchor are numbered above the 33 bits of the anchor
    keyed = plain.select((F.col("anchor") + F.shiftleft("part", 33)).alias("anchor"), *parts_of)
    dealt = keyed.repartition(parts, "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(_compare, "u long, v long")


def roots(classes: DataFrame, parts: list[str], node: str) -> DataFrame:
    """``classes`` (a row for each fingerprint) with ``root``, one fingerprint of the component."""
    spark = classes.sparkSession
    small = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8192")  # rows of two numbers
    try:
        edges = materialise(link_edges(classes.select(*parts)))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", small)
    return follow(classes, node, components(edges), "root")


def with_components(rows: DataFrame, parts: list[str], node: str) -> DataFrame:
    """``rows`` (doc_id, fingerprint in ``parts``, its name in ``node``) with the component_id that their fingerprint belongs to."""
    classes = materialise(rows.groupBy(*dict.fromkeys([*parts, node])).agg(F.min("doc_id").alias("least")))
    rooted = roots(classes, parts, node).select(node, "least", "root")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "__root")
    ids = materialise(rooted.join(named, F.col("root") == F.col("__root")).select(F.col(node).alias("__fp"), "component_id"))
    return rows.join(ids, F.col(node) == F.col("__fp"), "left").select(*rows.columns, "component_id")


def near_classes(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id of every row, by shingles."""
    return with_components(fingerprint_table(docs), ["fp"], "fp")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of every component, all columns: the smallest doc_id, ties by the row's hash."""
    key = row_key(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select("doc_id", key["a"].alias("ka"), key["b"].alias("kb"), "text")
    rows = fingerprint_table(keyed, "ka", "kb")
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("least"), "ka", "kb")).alias("first")
    classes = materialise(rows.groupBy("fp").agg(first))
    kept = materialise(roots(classes, ["fp"], "fp").groupBy("root").agg(F.min("first").alias("first")).select("first.*"))
    # the rows that go are fewer than those that stay; their keys are dealt by a hash, so many copies of one row can be split
    mark = lambda d: d.select(F.xxhash64("ka", "kb").alias("__mark"), F.col("ka").alias("__ka"), F.col("kb").alias("__kb"))
    same = (F.col("mark") == F.col("__mark")) & (F.col("ka") == F.col("__ka")) & (F.col("kb") == F.col("__kb"))
    counted = rows.groupBy("ka", "kb").agg(F.count(F.lit(1)).alias("n"))
    gone = materialise(mark(counted.withColumn("mark", F.xxhash64("ka", "kb")).join(mark(kept), same, "left_anti")))
    again = materialise(mark(counted.filter("n > 1").withColumn("mark", F.xxhash64("ka", "kb")).join(mark(kept), same, "left_semi")))
    taken = set(docs.columns)
    names = [next(x for x in (f"{c}{'_' * k}" for k in range(len(taken) + 1)) if x not in taken) for c in ("__a", "__b", "__m")]
    out = docs.withColumns({names[0]: key["a"], names[1]: key["b"]}).withColumn(names[2], F.xxhash64(*names[:2]))
    # whole rows are shuffled only where they may go or are repeated; the others are told by one bit of their mark and stay where they lie
    sure, open_ = by_marks(out, names[2], gone.unionByName(again))
    open_ = open_.join(gone, (F.col(names[2]) == F.col("__mark")) & (F.col(names[0]) == F.col("__ka")) & (F.col(names[1]) == F.col("__kb")), "left_anti")
    return sure.unionByName(open_ if again.isEmpty() else open_.dropDuplicates(names[:2])).drop(*names)


def op9_simhash_covering(spark: SparkSession, folder: str) -> DataFrame:
    prepare(spark)
    out = near_classes(table(spark, folder, "documents", "doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
