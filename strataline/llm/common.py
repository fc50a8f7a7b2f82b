"""Helpers shared by the operators of this folder: reading tables, Arrow batches, shipped functions, row keys."""

from __future__ import annotations

import sys
import types
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure

BATCH_ROWS = 256
#: Bits that ``by_marks`` broadcasts, 64 to a row: never more than MARKS / 64 rows, however many marks there are.
MARKS = 1 << 24


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings: small Arrow batches, because one row can hold a very long text."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*[df[f"`{c}`"] for c in columns]) if columns else df


def ship(*modules: str) -> None:
    """Send these modules inside the pickled functions, so executors need no copy of the package."""
    for m in modules:
        cloudpickle.register_pickle_by_value(sys.modules[m])


ship(__name__)


def share(spark: SparkSession, value: object):
    """Broadcast of a bounded value of a class from these modules; ``pickle.loads(x.value)`` gives it back."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def kept_in_worker(key: tuple, make: Callable[[], object]) -> object:
    """A compiled value that later tasks of the same Python worker use again (Spark reuses workers). The last one only; what it
    remembers must be bounded. A lost worker just makes it anew."""
    home = sys.modules.setdefault("_kept_in_worker", types.ModuleType("_kept_in_worker"))
    if getattr(home, "key", None) != key:
        home.key, home.value = None, None
        home.value = make()
        home.key = key
    return home.value


def rows_of(batches: Iterable[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Rows of the named columns, in order, one batch in memory at a time."""
    for b in batches:
        yield from zip(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in columns])


def batched(rows: Iterable[tuple], schema: pa.Schema, size: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``size`` rows."""
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


def per_row(df: DataFrame, inputs: list[str], row: Callable[..., tuple], schema: str, arrow: pa.Schema,
            start: Callable[[], Callable[..., tuple]] | None = None) -> DataFrame:
    """``row(*inputs) -> output tuple`` over Arrow batches. ``start()`` builds ``row`` once per task when it needs a state."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = start() if start else row
        return batched((f(*r) for r in rows_of(batches, *inputs)), arrow)
    return df.select(*[df[f"`{c}`"] for c in inputs]).mapInArrow(work, schema)


def row_key(*columns: Column) -> Column:
    """128-bit identity of a row, as a struct of two independent 64-bit hashes. Equal rows have equal keys."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(7), *columns).alias("b"))


def by_marks(rows: DataFrame, mark: str, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two parts: those whose ``mark`` is surely not among ``marks`` (column __mark), and the others. The second part also holds
    the rows whose mark has a bit in common with one of them, about one in MARKS / number of marks."""
    bit = lambda c: F.expr(f"shiftleft(1L, cast(pmod(`{c}`, 64) as int))")
    word = lambda c: F.shiftright(F.pmod(F.col(f"`{c}`"), F.lit(MARKS)), 6)
    words = F.broadcast(marks.groupBy(word("__mark").alias("__word")).agg(F.bit_or(bit("__mark")).alias("__bits")))
    told = rows.join(words, word(mark) == F.col("__word"), "left")
    hit = F.coalesce(F.col("__bits").bitwiseAND(bit(mark)) != 0, F.lit(False))
    return tuple(told.filter(x).select(*[F.col(f"`{c}`") for c in rows.columns]) for x in (~hit, hit))


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32(doc_id as text) mod 4 is 2 are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def held_out_id(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def documents_like(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in columns])
