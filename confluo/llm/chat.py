"""Chat formatting by columnar byte assembly.

A conversation becomes one string, its turns in order:

    ### Role: text</turn>\\n

Backslash, '#' and '<' inside a text or a role get a backslash after them (and ':' inside a role), so no control
string can appear in content, and unescape() gives every text back. A whole Arrow batch is assembled at once: segment
lengths, cumulative offsets and scatter indices are computed in numpy, and headers, contents and turn ends are copied
into one preallocated buffer, of which the output column is a view. The loss mask lists the byte ranges of assistant
contents.

Defined cases: a null text is empty, a null role is an empty role, which is read back as an empty role; turns are
ordered by turn (null first), ties by role and text, and repeated rows are turns of their own; rows without conv_id
make up one conversation; an empty table gives an empty table; other columns of the input are not carried. One
conversation, being one value of the output, must fit in a task's memory; any number of them streams through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD, AFTER_ROLE, END = b"### ", b": ", b"</turn>\n"
LEARNED_ROLE = "assistant"
SCHEMA = "conv_id long, n_turns long, formatted string, loss array<struct<start:long,end:long>>"
_LOSS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
ARROW_SCHEMA = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.large_string()), ("loss", _LOSS)])


def _escape_role(role: str) -> bytes:
    return "".join(c + "\\" if c in "\\#<:" else c for c in role).encode("utf-8", "surrogatepass")


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column one after the other, and its n + 1 offsets."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def assemble(conv: list, roles: list[str], texts: pa.Array) -> pa.RecordBatch:
    """Format rows that are in order and hold whole conversations."""
    n = len(roles)
    raw, offsets = _joined(texts)
    special = (raw == ord("\\")) | (raw == ord("#")) | (raw == ord("<"))
    added = np.concatenate([[0], np.cumsum(special)])
    lengths = np.diff(offsets) + added[offsets[1:]] - added[offsets[:-1]]
    kinds, which = np.unique(np.array(roles, object), return_inverse=True)
    head_of = [HEAD + _escape_role(k) + AFTER_ROLE for k in kinds]
    heads = np.array([len(h) for h in head_of], np.int64)[which]
    segment = heads + lengths + len(END)
    begin = np.cumsum(segment) - segment
    out = np.empty(int(segment.sum()), np.uint8)
    for k, head in enumerate(head_of):
        own = begin[which == k]
        out[own[:, None] + np.arange(len(head))] = np.frombuffer(head, np.uint8)
    content = begin + heads
    place = np.repeat(content - offsets[:-1] - added[offsets[:-1]], np.diff(offsets)) + np.arange(len(raw)) + added[:-1]
    out[place] = raw
    out[place[special] + 1] = ord("\\")
    out[(content + lengths)[:, None] + np.arange(len(END))] = np.frombuffer(END, np.uint8)

    new = np.array([i == 0 or conv[i] != conv[i - 1] for i in range(n)])
    first = np.flatnonzero(new)
    stops = np.append(first[1:], n)
    bounds = np.append(begin[first], len(out)).astype(np.int64)
    base = bounds[:-1][np.cumsum(new) - 1]
    learned = np.array([k == LEARNED_ROLE for k in kinds])[which]
    counts = np.concatenate([[0], np.cumsum(learned)])
    loss = pa.ListArray.from_arrays(
        pa.array(np.append(counts[first], counts[-1]), pa.int32()),
        pa.StructArray.from_arrays([pa.array((content - base)[learned]), pa.array((content + lengths - base)[learned])], ["start", "end"]),
    )
    text = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(bounds), pa.py_buffer(out))
    return pa.record_batch([pa.array([conv[i] for i in first], pa.int64()), pa.array(stops - first, pa.int64()), text, loss], schema=ARROW_SCHEMA)


def _run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation; the last conversation of a batch waits for the next."""
    waiting: list[pa.Table] = []
    last = object()

    def flush(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        conv, roles = table.column(0).to_pylist(), [r or "" for r in table.column(1).to_pylist()]
        texts = table.column(2).combine_chunks() if table.column(2).num_chunks != 1 else table.column(2).chunk(0)
        return assemble(conv, roles, texts)

    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column(0).to_pylist()
        start = len(conv) - 1
        while start and conv[start - 1] == conv[-1]:
            start -= 1
        table = pa.Table.from_batches([batch])
        if start or (waiting and conv[0] != last):
            ready = [*waiting, table.slice(0, start)]
            if sum(t.num_rows for t in ready):
                yield flush(pa.concat_tables(ready))
            waiting = [table.slice(start)]
        else:
            waiting.append(table)
        last = conv[-1]
    if waiting:
        yield flush(pa.concat_tables(waiting))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> one row a conversation: its formatted string and loss mask (byte ranges)."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(_run, SCHEMA)


def unescape(content: bytes, special: bytes = b"#<") -> str:
    raw = np.frombuffer(content, np.uint8)
    return raw[_unescaped(raw, special)].tobytes().decode("utf-8", "surrogatepass")


def _unescaped(raw: np.ndarray, special: bytes) -> np.ndarray:
    """Which bytes stay: a backslash after a special byte goes, and of a run of others every second one."""
    slash = raw == ord("\\")
    keep = ~slash
    at = np.flatnonzero(slash)
    if len(at):
        new = np.concatenate([[True], np.diff(at) > 1])
        first = at[new]
        guarded = (first > 0) & np.isin(raw[first - 1], list(special))  # the run's first guards the byte before it
        run = np.cumsum(new) - 1
        keep[at] = (at - first[run]) % 2 == guarded[run]
    return keep


def parse(formatted: bytes) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    turns = []
    for segment in formatted.split(END)[:-1]:
        colon = segment.index(AFTER_ROLE, len(HEAD))  # inside a role a backslash follows the colon
        turns.append((unescape(segment[len(HEAD) : colon], b"#<:"), unescape(segment[colon + len(AFTER_ROLE) :])))
    return turns


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted strings and their loss masks hold, as digests."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv_id, text, loss in zip(*(batch.column(i).to_pylist() for i in range(3))):
                raw = text.encode()
                turns, learned = parse(raw), "".join(unescape(raw[x["start"] : x["end"]]) for x in loss)
                whole = "".join(f"{role}\n{content}\n" for role, content in turns)
                rows.append((conv_id, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(text)))
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return formatted.select("conv_id", "formatted", "loss").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
