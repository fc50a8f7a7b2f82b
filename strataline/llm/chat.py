r"""Chat formatting with a grammar round trip.

Grammar of formatted text::

    conversation := turn*
    turn         := header body "\n</turn>\n"
    header       := "### " role ": "
    control      := header | "</turn>"

Inside a body every control string carries one more backslash in front than the source text has; the parser takes one away again. A
turn is first rendered as it is, reparsed by the deterministic parser and compared with its source; where they differ, or the parser
meets a control string that is not its own, the conflicting text is escaped and the turn is checked again, until both are identical.

A conversation is written as consecutive segments, one per turn, with offsets in the formatted text: nothing is collected per
conversation, so memory stays bounded for conversations of any length (one long conversation is still ordered within one task).

Defined results
* Turns are ordered by turn (null first), then role, then text; repeated rows are repeated turns.
* Null text and null role count as empty. Roles outside user, assistant and system are written percent-encoded after "@".
* A null conv_id is a conversation of its own. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batched, prepare, rows_of, ship, table

NAMED = {"user": "User", "assistant": "Assistant", "system": "System"}
ROLES = {v: k for k, v in NAMED.items()}
_HEADER = r"### (User|Assistant|System|@[A-Za-z0-9_%-]*): "
HEADER = re.compile(_HEADER)
#: A run of backslashes is read once, from its beginning.
CONTROL = re.compile(rf"(?<!\\)(\\*+)({_HEADER}|</turn>)")
END = "\n</turn>\n"


class Conflict(ValueError):
    """The text does not follow the grammar."""


def role_name(role: str) -> str:
    return NAMED.get(role) or "@" + re.sub(r"[^A-Za-z0-9_-]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "surrogatepass")), role)


def role_of(name: str) -> str:
    if name in ROLES:
        return ROLES[name]
    return re.sub(r"(?:%[0-9A-F]{2})+", lambda m: bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "surrogatepass"), name[1:])


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(body: str) -> str:
    return CONTROL.sub(lambda m: m[0][1:] if m[1] else m[0], body)


def parse(text: str) -> Iterator[tuple[str, str, int, int]]:
    """Role, recovered text, and where the body starts and ends, turn by turn. Raises ``Conflict`` off the grammar."""
    at = 0
    while at < len(text):
        head = HEADER.match(text, at)
        if not head:
            raise Conflict(f"no header at {at}")
        end = text.find(END, head.end())
        if end < 0:
            raise Conflict(f"no end of the turn at {at}")
        body = text[head.end():end]
        if any(not m[1] for m in CONTROL.finditer(body)):
            raise Conflict(f"control string inside the turn at {at}")
        yield role_of(head[1]), unescape(body), head.end(), end
        at = end + len(END)


def survives(segment: str, role: str, text: str) -> bool:
    try:
        return [(r, t) for r, t, _, _ in parse(segment)] == [(role, text)]
    except Conflict:
        return False


def render(role: str, text: str) -> tuple[str, int, int, int]:
    """Segment of one turn, body start and end in it, and how often the text had to be escaped."""
    head = f"### {role_name(role)}: "
    body = text
    for level in range(3):
        segment = head + body + END
        if survives(segment, role, text):
            return segment, len(head), len(head) + len(body), level
        body = escape(text)
    raise Conflict("the turn does not survive its round trip")


_SEGMENTS = "conv_id long, place long, segment string, start long, mask_start long, mask_end long, escaped int"
_SEGMENTS_ARROW = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("segment", pa.string()), ("start", pa.int64()),
                             ("mask_start", pa.int64()), ("mask_end", pa.int64()), ("escaped", pa.int32())])


def _write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def segments():
        now, place, start = object(), 0, 0
        for conv, role, text in rows_of(batches, "conv_id", "role", "text"):
            if conv != now:
                now, place, start = conv, 0, 0
            segment, a, b, level = render(role, text)
            loss = role == "assistant"
            yield conv, place, segment, start, start + a if loss else None, start + b if loss else None, level
            place, start = place + 1, start + len(segment)
    return batched(segments(), _SEGMENTS_ARROW)


def format_turns(conversations: DataFrame) -> DataFrame:
    """One row per turn: the formatted segment, its start in the conversation's text, and the loss mask (assistant bodies).

    The rows of a conversation are consecutive and in order within one partition.
    """
    c = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                             F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return c.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn").mapInArrow(_write, _SEGMENTS)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conversation: the whole formatted text and the mask's spans. For conversations that fit in a row."""
    s = F.array_sort(F.collect_list(F.struct("place", "segment", "mask_start", "mask_end")))
    return format_turns(conversations).groupBy("conv_id").agg(s.alias("s")).select(
        "conv_id", F.array_join(F.col("s.segment"), "").alias("formatted"),
        F.transform(F.filter("s", lambda x: x["mask_start"].isNotNull()), lambda x: F.struct(x["mask_start"].alias("start"), x["mask_end"].alias("end"))).alias("mask"))


_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_READ_ARROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                         ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    utf8 = lambda x: x.encode("utf-8", "surrogatepass")

    def conversations():
        now = state = None
        for conv, segment, start, a, b in rows_of(batches, "conv_id", "segment", "start", "mask_start", "mask_end"):
            if state is None or conv != now:
                if state is not None:
                    yield done(now, state)
                now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text, _, _ in parse(segment):
                state[0] += 1
                state[1].update(utf8(f"{role}\n{text}\n"))
            if a is not None:
                masked = unescape(segment[a - start:b - start])
                state[2] += len(masked)
                state[3].update(utf8(masked))
            state[4] = start + len(segment)
        if state is not None:
            yield done(now, state)

    def done(conv, s):
        return conv, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4]

    return batched(conversations(), _READ_ARROW)


def read_back(segments: DataFrame) -> DataFrame:
    """Digests of what the parser recovers from the segments of ``format_turns`` (read in their order, without a shuffle)."""
    return segments.mapInArrow(_read, _READ)


ship(__name__)


def op3_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    prepare(spark)
    rows = table(spark, folder, "conversations", "conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(format_turns(rows.unionByName(extra)))
