"""Substring dedup by hashing lines cut into sentences.

Units are the sentences of every line (a line without sentence ends is one unit), so a passage keeps most of its units where it is
pasted into the middle of a line. Units are normalised (case, white space) and hashed to 96 bits; digests are grouped over all
documents; the earliest occurrence by (doc_id, place in the text) stays. Runs of consecutive repeated units are removed when they hold
``min_words`` words or more; offsets of the original text are kept.

Passages (``passages``): units say nothing about text that is shared inside a unit or that ends in the middle of one. Therefore windows of
``GRAM`` words are compared as well, and a run of ``PASSAGE`` words or more whose windows have all occurred earlier goes, to the word. Texts are
cut into chunks at sampled windows, which their words alone choose: the least hash of each ``REACH`` windows that follow each other. A passage
that two texts share has the same sampled windows in both, except near its ends. Where all places of a sampled window go on with the
same chunk, the chunk repeats as a whole and one row says so; only beside sampled windows whose places go on differently are the windows
looked at one by one. So every passage of ``PASSAGE`` words that occurs in an earlier place is found, and what goes has occurred
earlier window by window.

How it runs: the 96-bit digests go with their place, but without text or offsets, through one exchange by digest; a task reads them in
order and settles one digest after another, so digests that occur once need no join. Digests with very many rows, told from one text in
``FEW``, are dealt to several tasks by place as well; their first place is found by an aggregate, of which there is one row for each such digest.
The sample only says how rows are dealt, no result depends on it. Offsets are found again where the text is cut.

Defined results
* Null text stays null and has no units. Rows with equal doc_id and text are one document: they get the same result.
* Null doc_ids rank last; different texts under one doc_id rank by a hash of the text.
* A repeat inside one document also counts; its first place stays. Extra columns pass through ``remove_repeats`` unchanged.
* An empty table gives an empty table. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from .common import by_marks, prepare, rows_of, ship, table

#: Runs of repeated units shorter than this many words stay.
MIN_WORDS = 10
#: Repeated passages of this many words are found wherever they begin and end, by windows of GRAM words.
PASSAGE = 50
GRAM = 25
REACH = PASSAGE - GRAM + 1
LAST = (1 << 63) - 1
#: Places from here on number the windows of a text, those below its units.
WINDOW = 1 << 30

_SPACE = np.array([chr(c).isspace() for c in range(0x3002)])  # no white space beyond U+3000


def word_places(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and of each unit that has a word its first word and the one behind its last."""
    code = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), len(_SPACE) - 1)
    turns = np.flatnonzero(np.diff(_SPACE[code].astype(np.int8), prepend=1, append=1))
    starts, ends = turns[::2], turns[1::2]
    # a unit ends with a word that ends a sentence or a line
    lines = np.concatenate([[0], np.cumsum(code == ord("\n"))])
    last = np.isin(code[ends - 1], [ord(c) for c in ".!?"])
    last[:-1] |= lines[starts[1:]] > lines[ends[:-1]]
    last[-1:] = True
    behind = np.flatnonzero(last) + 1
    return starts, ends, np.concatenate([[0], behind[:-1]])[:len(behind)], behind


def units(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """Start, end and normalised words of each unit that has a word, in order."""
    starts, ends, first, behind = word_places(text)
    for a, b in zip(starts[first].tolist(), ends[behind - 1].tolist()):
        yield a, b, text[a:b].lower().split()


def normal(text: str) -> list[bytes]:
    """The normalised words of each unit that has a word."""
    lines = "\n".join([" ".join(line.split()) for line in text.lower().split("\n")])
    for c in ".!?":
        lines = lines.replace(f"{c} ", f"{c}\n")
    return [x for x in lines.encode("utf-8", "surrogatepass").split(b"\n") if x]


_BASE = 0x9E3779B97F4A7C15


def windows(text: str) -> np.ndarray:
    """Hash of the GRAM words that begin at each word; nothing if the text is shorter than a passage."""
    return _windows(" ".join(text.lower().split()).encode("utf-8", "surrogatepass").split(b" "))


def _windows(words: list[bytes]) -> np.ndarray:
    if len(words) < PASSAGE:
        return np.zeros(0, np.uint64)
    part = {1: np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), np.uint64)}
    for n in (1, 2, 4, 8):
        part[2 * n] = part[n][:-n] * np.uint64(pow(_BASE, n, 1 << 64)) + part[n][n:]
    total = len(words) - GRAM + 1  # 25 = 16 + 8 + 1
    x = part[16][:total] * np.uint64(pow(_BASE, 9, 1 << 64)) + part[8][16:16 + total] * np.uint64(_BASE) + part[1][24:]
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _sliding(x: np.ndarray, better: np.ufunc) -> np.ndarray:
    """The best of each REACH neighbours."""
    n = 1
    out = x
    while 2 * n <= REACH:
        out = better(out[:-n], out[n:])
        n *= 2
    rest = REACH - n
    return better(out[:len(out) - rest], out[rest:]) if rest else out


def sampled(window: np.ndarray) -> np.ndarray:
    """Places of the windows that are the least of some REACH windows that follow each other."""
    if len(window) < REACH:
        return np.zeros(0, np.int64)
    none = np.zeros(REACH - 1, np.uint64)
    return np.flatnonzero(_sliding(np.concatenate([none, _sliding(window, np.minimum), none]), np.maximum) == window)


#: ``n`` windows begin from ``place`` to the end of the chunk; ``before`` and ``behind`` are digests of the chunks beside a sampled window
_UNITS = pa.schema([("a", pa.int64()), ("b", pa.int32()), ("doc", pa.int64()), ("tie", pa.int64()), ("place", pa.int32()), ("n", pa.int32()),
                    ("before", pa.int64()), ("behind", pa.int64())])


def _digests(parts: list[bytes | memoryview]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, parts)), np.int64)


def _places_of(text: str, passages: bool) -> list[np.ndarray]:
    """a, b, place, n, before and behind of the units and sampled windows of a text."""
    parts = normal(text)
    none = np.zeros(len(parts), np.int64)
    b = np.array([xxhash.xxh32_intdigest(x, 7) for x in parts], np.int64) - (1 << 31)
    cols = [_digests(parts), b.astype(np.int32), np.arange(len(parts), dtype=np.int32), np.ones(len(parts), np.int32), none, none]
    every = _windows(b" ".join(parts).split(b" ")) if passages else none[:0]
    at = sampled(every)
    if not len(at):
        return cols
    # the first chunk begins with the text, the last one ends with it
    ends = np.concatenate([at, [len(every) - 1]])
    whole = memoryview(every.tobytes())
    chunk = _digests([whole[8 * p:8 * z + 8] for p, z in zip([0, *at.tolist()], ends.tolist())])
    more = [every[at].view(np.int64), np.zeros(len(at), np.int32), (at + WINDOW).astype(np.int32), (ends[1:] - at + 1).astype(np.int32), chunk[:-1], chunk[1:]]
    return [np.concatenate(x) for x in zip(cols, more)]


def _units(batches: Iterable[pa.RecordBatch], passages: bool = False) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = list(rows_of([b], "doc", "tie", "text"))
        if not rows:
            continue
        found = [_places_of(text or "", passages) for _, _, text in rows]
        sizes = [len(f[0]) for f in found]
        a, digest, place, n, before, behind = (np.concatenate(x) for x in zip(*found))
        doc, tie = (np.repeat(np.array(x, np.int64), sizes) for x in ([r[0] for r in rows], [r[1] for r in rows]))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (a, digest, doc, tie, place, n, before, behind)], schema=_UNITS)


_TOLD = pa.schema([*_UNITS, ("open", pa.bool_()), ("later", pa.bool_()), ("same_before", pa.bool_()), ("same_behind", pa.bool_())])
_NUMPY = [np.dtype(f.type.to_pandas_dtype()) for f in _UNITS]
#: Rows that are settled at a time (whole groups).
HELD = 1 << 17
#: Digests with more rows than HOT, as far as one text in FEW tells, are dealt to several tasks.
HOT, FEW = 100_000, 64


def _told(cols: list[np.ndarray], **more: np.ndarray) -> pa.RecordBatch:
    none = np.zeros(len(cols[0]), bool)
    return pa.RecordBatch.from_arrays([*[pa.array(c) for c in cols], *[pa.array(more.get(f.name, none)) for f in list(_TOLD)[len(cols):]]], schema=_TOLD)


def _settle_groups(cols: list[np.ndarray]) -> pa.RecordBatch:
    """Of whole groups, sorted by ``a``: the rows that are later than the first of their digest or go on differently, without the digests."""
    start = np.flatnonzero(np.concatenate([[True], cols[0][1:] != cols[0][:-1]]))
    sizes = np.diff(np.append(start, len(cols[0])))
    several = np.flatnonzero(np.repeat(sizes > 1, sizes))
    a, b, doc, tie, place = (c[several] for c in cols[:5])
    order = np.lexsort((place, tie, doc, b, a))
    a, b, doc, tie, place, n, before, behind = (c[several[order]] for c in cols)
    start = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[:len(a)]
    group, first = np.cumsum(start) - 1, np.flatnonzero(start)
    head = first[group]
    later = (doc != doc[head]) | (tie != tie[head]) | (place != place[head])
    same = [~np.logical_or.reduceat(c != c[head], first)[group] if len(a) else later for c in (before, behind)]
    at = np.flatnonzero(later | (place >= WINDOW) & ~(same[0] & same[1]))
    zero = np.zeros(len(at), np.int64)
    return _told([zero, zero.astype(np.int32), doc[at], tie[at], place[at], n[at], zero, zero], later=later[at], same_before=same[0][at], same_behind=same[1][at])


def _settle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``a``; those with a ``salt`` have others of their digest in other tasks and are left ``open``."""
    held, n = [], 0
    for b in batches:
        cols = [b.column(k).to_numpy(zero_copy_only=False).astype(t, copy=False) for k, t in enumerate(_NUMPY)]
        dealt = b.column(len(cols)).to_numpy(zero_copy_only=False) > 0
        if dealt.any():
            yield _told([c[dealt] for c in cols], open=dealt[dealt])
            cols = [c[~dealt] for c in cols]
        held.append(cols)
        n += len(cols[0])
        if n >= HELD:
            cols = [np.concatenate(x) for x in zip(*held)]
            done = int(np.searchsorted(cols[0], cols[0][-1]))
            if done:
                yield _settle_groups([c[:done] for c in cols])
            held, n = [[c[done:] for c in cols]], n - done
    if n:
        yield _settle_groups([np.concatenate(x) for x in zip(*held)])


_BESIDE = pa.schema([("a", pa.int64()), ("doc", pa.int64()), ("tie", pa.int64()), ("place", pa.int32())])


def _beside(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows that can belong to a passage with one of the ``found`` sampled windows, on the sides where its places differ."""
    for b in batches:
        for doc, tie, text, found in rows_of([b], "doc", "tie", "text", "found"):
            every = windows(text)
            near = np.zeros(len(every) + 1, np.int64)
            for f in found:
                at = f["place"] - WINDOW
                near[at if f["same_before"] else max(at - REACH + 1, 0)] += 1
                near[at + 1 if f["same_behind"] else min(at + REACH, len(every))] -= 1
            at = np.flatnonzero(np.cumsum(near)[:-1] > 0)
            cols = [every[at].view(np.int64), np.full(len(at), doc, np.int64), np.full(len(at), tie, np.int64), (at + WINDOW).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _BESIDE)], schema=_BESIDE)


def _runs(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last of the runs of true values."""
    turns = np.flatnonzero(np.diff(np.concatenate([[False], at, [False]]).astype(np.int8)))
    return zip(turns[::2].tolist(), (turns[1::2] - 1).tolist())


def cut(text: str | None, place: np.ndarray, n: np.ndarray, min_words: int) -> tuple[str | None, list[tuple[int, int]], int]:
    """The text without the long enough runs of units and windows that were found (first ``place`` and number ``n``), their spans in
    the original, and the number of units removed."""
    if text is None or not len(place):
        return text, [], 0
    starts, ends, first, behind = word_places(text)
    repeated = np.zeros(len(first), bool)
    repeated[place[place < WINDOW]] = True
    spans, removed = [], 0
    for a, z in _runs(repeated):
        if behind[z] - first[a] >= min_words:
            spans.append((int(starts[first[a]]), int(ends[behind[z] - 1])))
            removed += z - a + 1
    window = place >= WINDOW
    if window.any():
        near, at = np.zeros(len(starts) + 1, np.int64), place[window].astype(np.int64) - WINDOW
        np.add.at(near, at, 1)
        np.add.at(near, at + n[window], -1)
        longer = [(int(starts[a]), int(ends[z + GRAM - 1])) for a, z in _runs(np.cumsum(near) > 0) if z - a + 1 >= REACH]
        if longer:
            joined: list[tuple[int, int]] = []
            for a, b in sorted([*spans, *longer]):
                if joined and a <= joined[-1][1]:
                    joined[-1] = joined[-1][0], max(b, joined[-1][1])
                else:
                    joined.append((a, b))
            spans = joined
            begin, end = np.array(spans).T
            k = np.searchsorted(end, starts[first], side="right")  # units that lose words
            removed = int(np.count_nonzero(np.append(begin, len(text))[k] < ends[behind - 1]))
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return "".join([*out, text[at:]]), spans, removed


_BESIDE_DDL = "a long, doc long, tie long, place int"
_UNITS_DDL = "a long, b int, doc long, tie long, place int, n int, before long, behind long"
_TOLD_DDL = _UNITS_DDL + ", open boolean, later boolean, same_before boolean, same_behind boolean"

ship(__name__)


def _few(rows: DataFrame) -> DataFrame:
    return rows.filter(F.pmod(F.xxhash64("doc", "tie"), F.lit(FEW)) == 0)


def _settled(rows: DataFrame, few: DataFrame) -> DataFrame:
    """The rows that are not the earliest of their digest (``later``) or go on differently at different places (``mixed``): doc, tie,
    place, n, later, mixed, same_before, same_behind. ``few``: the rows of one text in FEW."""
    spark, names = rows.sparkSession, _UNITS.names
    seen = few.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT // FEW)
    hot = materialise(seen.select(F.col("a").alias("hot"), F.ceil(F.col("n") * FEW / HOT).cast("int").alias("salts")))
    some = not hot.isEmpty()
    salted = rows.select(*names).withColumn("salt", F.lit(0))
    if some:  # of HOT rows there are few digests
        salt = F.coalesce(F.pmod(F.xxhash64("doc", "tie", "place"), F.col("salts")).cast("int") + 1, F.lit(0))
        salted = salted.join(F.broadcast(hot), F.col("a") == F.col("hot"), "left").select(*names, salt.alias("salt"))
    # rows are short: as many to a batch as a batch of texts may have bytes
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": "16384", "spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 20)}
    were = {k: spark.conf.get(k) for k in limits}
    for k, v in limits.items():
        spark.conf.set(k, v)
    try:
        told = materialise(salted.repartition("a", "salt").sortWithinPartitions("a").mapInArrow(_settle, _TOLD_DDL))
    finally:
        for k, v in were.items():
            spark.conf.set(k, v)
    if some:
        rank = F.struct("doc", "tie", "place")
        same = [(F.min(c) == F.max(c)).alias(f"all_{c}") for c in ("before", "behind")]
        groups = told.filter("open").groupBy("a", "b").agg(F.min(rank).alias("first"), *same).withColumnsRenamed({"a": "fa", "b": "fb"})
        told = told.join(F.broadcast(materialise(groups)), F.col("open") & (F.col("a") == F.col("fa")) & (F.col("b") == F.col("fb")), "left")
        told = told.withColumns({"later": F.when(F.col("open"), rank != F.col("first")).otherwise(F.col("later"))} | {
            f"same_{c}": F.coalesce(f"all_{c}", f"same_{c}") for c in ("before", "behind")})
    mixed = (F.col("place") >= WINDOW) & ~(F.col("same_before") & F.col("same_behind"))
    told = told.select("doc", "tie", "place", "n", "later", mixed.alias("mixed"), "same_before", "same_behind")
    return told.filter("later OR mixed")


def repeated_units(docs: DataFrame, passages: bool = False) -> DataFrame:
    """Units (and ``n`` windows from ``place`` on, numbered from WINDOW) that are not the earliest occurrence of their digest: doc, tie, place, n."""
    found_in = lambda d: d.select("doc", "tie", "text").mapInArrow(lambda batches: _units(batches, passages), _UNITS_DDL)
    told = _settled(found_in(docs), found_in(_few(docs)))
    whole = told.filter("later").select("doc", "tie", "place", F.when(F.col("same_behind"), F.col("n")).otherwise(1).alias("n"))
    if not passages:
        return whole
    found = told.filter("mixed").groupBy(F.col("doc").alias("d"), F.col("tie").alias("t")).agg(
        F.collect_set(F.struct("place", "same_before", "same_behind")).alias("found")).withColumn("found_key", F.xxhash64("d", "t"))
    found = materialise(found)
    # only texts with a mixed window, and few others, are shuffled
    texts = by_marks(docs.withColumn("text_key", F.xxhash64("doc", "tie")), "text_key", found.select(F.col("found_key").alias("__mark")))[1]
    texts = texts.join(found, (F.col("text_key") == F.col("found_key")) & (F.col("doc") == F.col("d")) & (F.col("tie") == F.col("t")))
    none = F.lit(0).cast("bigint")
    beside = materialise(texts.select("doc", "tie", "text", "found").mapInArrow(_beside, _BESIDE_DDL))
    beside = beside.withColumns({"b": F.lit(0), "n": F.lit(1), "before": none, "behind": none})
    single = _settled(beside, _few(beside))
    return whole.unionByName(single.filter("later").select("doc", "tie", "place", "n"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, passages: bool = False) -> DataFrame:
    """All columns and rows of ``docs`` with repeated runs of units (and ``passages`` to the word) cut out of ``text``, and ``__spans``
    (array of start, stop in the original text) and ``__n_removed`` (units that lose words)."""
    doc = F.coalesce(F.col(f"`{doc_id}`").cast("bigint"), F.lit(LAST))
    # only rows that share a doc_id need the hash of their text to tell them apart
    shared = not docs.groupBy(doc.alias("doc")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    tie = F.xxhash64(F.col(f"`{text}`")) if shared else F.lit(0).cast("bigint")
    later = repeated_units(docs.select(doc.alias("doc"), tie.alias("tie"), F.col(f"`{text}`").alias("text")), passages)
    own = "__own"  # no column of docs begins with it
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    # repeated rows give the same units twice: a set
    by_doc = later.groupBy(F.col("doc").alias(f"{own}d"), F.col("tie").alias(f"{own}t")).agg(
        F.collect_set(F.shiftleft(F.col("place").cast("bigint"), 32) + F.col("n")).alias(f"{own}found"))
    by_doc = by_doc.withColumn(f"{own}k", F.xxhash64(f"{own}d", f"{own}t"))
    # the computed key lets adaptive execution split one text on a third of all rows
    marked = docs.withColumns({f"{own}doc": doc, f"{own}tie": tie}).withColumn(f"{own}key", F.xxhash64(f"{own}doc", f"{own}tie"))
    on = (F.col(f"{own}key") == F.col(f"{own}k")) & (F.col(f"{own}doc") == F.col(f"{own}d")) & (F.col(f"{own}tie") == F.col(f"{own}t"))
    joined = marked.join(by_doc, on, "left").select(*[F.col(f"`{c}`") for c in docs.columns], f"{own}found")
    out = docs.select("*", F.lit(None).cast("array<struct<start:int,stop:int>>").alias("__spans"), F.lit(0).cast("bigint").alias("__n_removed")).schema

    def work(batches):
        for b in batches:
            at, f = b.schema.get_field_index(text), b.schema.get_field_index(f"{own}found")
            ends, found = b.column(f).offsets.to_numpy(), b.column(f).values.to_numpy(zero_copy_only=False)
            place, n = found >> 32, found & 0xFFFFFFFF
            done = [cut(t, place[p:z], n[p:z], min_words) for t, p, z in zip(b.column(at).to_pylist(), ends[:-1], ends[1:])]
            cols = [b.column(i) for i in range(b.num_columns) if i != f]
            names = [n for i, n in enumerate(b.schema.names) if i != f]
            cols[names.index(text)] = pa.array([d[0] for d in done], pa.string())
            spans = pa.array([[{"start": s, "stop": e} for s, e in d[1]] for d in done], pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))
            yield pa.RecordBatch.from_arrays([*cols, spans, pa.array([d[2] for d in done], pa.int64())], names=[*names, "__spans", "__n_removed"])
    return joined.mapInArrow(work, out)


def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, folder, "documents", "doc_id", "text")
    cutout = remove_repeats(docs, passages=True)
    spans = F.array_join(F.transform("__spans", lambda s: F.concat_ws(":", s["start"], s["stop"])), ",")
    return cutout.select("doc_id", F.col("__n_removed").alias("n_removed"),
                         F.aggregate("__spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"]).alias("removed_chars"),
                         spans.alias("spans"), "text")
