"""Removal of repeated passages: bytes covered by a string of at least `length` bytes that also starts earlier.

0. Copies. Texts that an earlier document has from end to end are found by their digests and go whole; what follows
   sees each distinct text once.
1. Anchors. Every string of `length` bytes holds the k-gram of least hash among those inside it (the leftmost, on
   ties), and equal strings hold it at the same place. Consecutive starts with the same anchor are one run. Anchor
   hashes are counted over all documents by Spark; only runs whose anchor stands twice somewhere go on.
2. Contexts. The text of a run, its starts and the length - 1 bytes after the last, goes to the task of its anchor
   hash, where equal contexts are one entry with all their places. An anchor with over HOT runs is parted: its strings
   that start far before it, and those that start near, by a hash of the bytes that all of them share, so that equal
   strings stay together. One with over HOTTEST runs goes to several tasks by document and place instead. So no task
   holds more than about HOTTEST runs of one anchor, however many documents have it.
3. Interval expansion. Per batch of anchors, the entries are joined by separators, sorted by prefix doubling into a
   Burrows-Wheeler transform, and breadth-first backward extension yields the common-prefix values 0, 1, 2, ... of
   neighbouring suffixes in this order. It stops at `length`: suffixes between two boundaries then share at least that
   much. Of each such class the earliest place stays; every later one is a span to remove. An anchor with one entry
   has nothing to compare: the starts of a run are different strings, and its later places go.
4. Of an anchor that several tasks share, each leaves the earliest place of every class with a 128-bit hash of its
   string. Spark reduces these to the first place of each string; the others are spans as well.
5. Spans return to their documents, are united there, and the text is cut.

Order is by document id, then by offset.

Defined cases: a null text is empty, texts shorter than `length` bytes lose nothing; any length of text is searched
whole; a null id sorts first; rows of one id are documents of their own, in the order of a hash of id and text; id
and hash name a row throughout, so that 64 bits only tell texts of one id apart; rows equal in id and text count as one document and do not remove each other; an empty table
gives an empty table; other columns are not carried. A cut may fall inside a character, so the kept text is binary.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluo.llm.common import drop_stored, release_memory, sieved, stored

K = 24
PIECE_BYTES = 1 << 20
TRANSFORM_BYTES = 1_500_000
HOT, HOTTEST = 8192, 32_768
PARTED = -1  # in place of a number of tasks
_SEPARATOR = 255  # no byte of UTF-8
row_hash = F.xxhash64


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k bytes, put together from those of powers of two."""
    with np.errstate(over="ignore"):
        part = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        part ^= part >> np.uint64(29)
        factor, size, out, done = np.uint64(0xBF58476D1CE4E5B9), 1, None, 0
        while True:
            if k & size:
                n = len(data) - done - size + 1
                out = part[:n] if out is None else out[:n] * factor + part[done : done + n]
                done += size
            if done == k:
                break
            part = part[:-size] * factor + part[size:]
            factor, size = factor * factor, 2 * size
        out = out ^ (out >> np.uint64(31))
        out = out * np.uint64(0x94D049BB133111EB)
        return out ^ (out >> np.uint64(29))


def runs(texts: list[bytes], length: int, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first start, starts, anchor place, anchor hash) of every run, with places inside their text."""
    none = np.zeros(0, np.int64)
    out = []
    for lo, hi, base in _pieces(texts, length):
        sizes = np.array([len(t) for t in texts[lo:hi]]) if base is None else np.array([base[1] - base[0]])
        data = np.frombuffer(b"".join(texts[lo:hi]) if base is None else texts[lo][base[0] : base[1]], np.uint8)
        if len(data) < length:
            continue
        ends = np.cumsum(sizes)
        hashed = gram_hashes(data, k)
        least = (hashed & ~np.uint64((1 << 24) - 1)) | np.arange(len(hashed), dtype=np.uint64)
        window, span = length - k + 1, 1
        while 2 * span <= window:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < window:
            least = np.minimum(least[: len(least) - (window - span)], least[window - span :])
        text = np.searchsorted(ends, np.arange(len(least)), side="right")
        start = np.flatnonzero(np.arange(len(least)) + length <= ends[text])
        anchor = (least[start] & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)])) if len(start) else none
        at = text[start[first]]
        shift = (ends - sizes)[at] - (0 if base is None else base[0])
        out.append((at + lo, start[first] - shift, np.diff(np.append(first, len(start))), anchor[first] - shift, hashed[anchor[first]].view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (none,) * 5


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[int, int, tuple[int, int] | None]]:
    """Ranges of texts of about PIECE_BYTES; a longer text alone, in parts that share length - 1 bytes."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if len(t) > 4 * PIECE_BYTES:
            if lo < i:
                yield lo, i, None
            for a in range(0, len(t) - length + 1, 4 * PIECE_BYTES):
                yield i, i + 1, (a, min(len(t), a + 4 * PIECE_BYTES + length - 1))
            lo, size = i + 1, 0
            continue
        size += len(t)
        if size > PIECE_BYTES:
            yield lo, i + 1, None
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts), None


def sort_suffixes(text: np.ndarray, length: int) -> np.ndarray:
    """Suffixes in the order of their first `length` bytes or more, by prefix doubling from 4 bytes."""
    n = len(text)
    bits = max(1, n.bit_length())
    padded = np.concatenate([text, np.zeros(4, np.uint8)]).astype(np.uint64)
    head = (padded[:n] << np.uint64(24)) | (padded[1 : n + 1] << np.uint64(16)) | (padded[2 : n + 2] << np.uint64(8)) | padded[3 : n + 3]
    low = np.uint64((1 << bits) - 1)
    if 32 + bits > 64:
        raise ValueError("text too long for one transform")
    packed = np.sort((head << np.uint64(bits)) | np.arange(n, dtype=np.uint64))
    order = (packed & low).astype(np.int64)
    group = packed >> np.uint64(bits)
    # rank: the place of the first suffix of the group
    new = np.concatenate([[True], group[1:] != group[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    done = 4
    while done < length:
        open_ = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(open_):
            break
        suffix = order[open_]
        ahead = suffix + done
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0).astype(np.uint64)
        if 3 * bits + 1 <= 64:
            packed = np.sort((rank[suffix].astype(np.uint64) << np.uint64(2 * bits + 1)) | (second << np.uint64(bits)) | suffix.astype(np.uint64))
            suffix, group = (packed & low).astype(np.int64), packed >> np.uint64(bits)
        else:
            key = (rank[suffix].astype(np.uint64) << np.uint64(32)) | second
            by = np.argsort(key, kind="stable")
            suffix, group = suffix[by], key[by]
        order[open_] = suffix
        changed = np.concatenate([[True], group[1:] != group[:-1]])
        new[open_] = changed
        rank[suffix] = open_[changed][np.cumsum(changed) - 1]
        done *= 2
    return order


def classes(text: np.ndarray, length: int) -> np.ndarray:
    """For each place of text a class number; places from which no separator stands within `length` bytes have the
    same class exactly if their next `length` bytes are equal."""
    n = len(text)
    order = sort_suffixes(text, length)
    transform = text[order - 1]  # the byte before each suffix; before the first stands the last, a separator
    step = np.empty(n, np.int64)
    step[np.argsort(transform, kind="stable")] = np.arange(n)  # where a suffix goes when extended by its byte
    known = np.zeros(n + 1, bool)  # boundaries whose common prefix is below the depth reached
    known[0] = known[n] = True
    begin, end = np.array([0]), np.array([n])
    change = np.cumsum(np.concatenate([[0], transform[1:] != transform[:-1]]))
    for _ in range(length):
        # an interval with one byte before all its suffixes moves as a whole
        alike = change[begin] == change[end - 1]
        whole, size = begin[alike], (end - begin)[alike]
        inside = transform[whole] != _SEPARATOR
        moved, size = step[whole[inside]], size[inside]
        begin, end = begin[~alike], end[~alike]
        # extensions by one byte of another interval are runs of consecutive places of the same interval
        count = end - begin
        at = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        of = np.repeat(np.arange(len(count)), count)
        inside = transform[at] != _SEPARATOR
        packed = np.sort((step[at[inside]].astype(np.uint64) << np.uint64(32)) | of[inside].astype(np.uint64))
        to, of = (packed >> np.uint64(32)).astype(np.int64), packed & np.uint64(0xFFFFFFFF)
        begin, end = moved, moved + size
        if len(to):
            cut = np.flatnonzero((to[1:] != to[:-1] + 1) | (of[1:] != of[:-1]) | (text[order[to[1:]]] != text[order[to[:-1]]])) + 1
            begin, end = np.concatenate([begin, to[np.concatenate([[0], cut])]]), np.concatenate([end, to[np.append(cut, len(to)) - 1] + 1])
        fresh = ~known[end]
        begin, end = begin[fresh], end[fresh]
        known[end] = True
        if not len(begin):
            break
    out = np.empty(n, np.int64)
    out[order] = np.cumsum(known[:n])
    return out


Span = tuple[np.ndarray, np.ndarray, np.ndarray]  # documents, starts, stops
First = tuple[bytes, int, int]  # string, document, start


def _spans(entries: list[tuple[bytes, int, np.ndarray, bool]], docs: np.ndarray, places: np.ndarray, rank: np.ndarray, length: int) -> tuple[list[Span], list[First]]:
    """Entries (context, number of starts, places in docs and places, shared) of some anchors -> spans to remove, and the
    firsts of the classes of shared anchors. rank orders places."""
    text = np.frombuffer(b"".join(c + b"\xff" for c, *_ in entries), np.uint8)
    begin = np.cumsum([len(c) + 1 for c, *_ in entries]) - [len(c) + 1 for c, *_ in entries]
    starts = np.array([n for _, n, *_ in entries])
    entry = np.repeat(np.arange(len(entries)), starts)
    inner = np.arange(len(entry)) - np.repeat(np.cumsum(starts) - starts, starts)
    own = classes(text, length)[np.repeat(begin, starts) + inner]
    first = np.array([rank[at].min() for _, _, at, _ in entries])
    least = np.full(int(own.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, own, first[entry])
    spans: list[Span] = []
    # of each entry's earliest place the starts go that stand earlier in another entry
    gone = np.flatnonzero(least[own] < first[entry])
    if len(gone):
        new = np.concatenate([[True], (gone[1:] != gone[:-1] + 1) | (entry[gone[1:]] != entry[gone[:-1]])])
        a, b = gone[new], gone[np.append(np.flatnonzero(new)[1:], len(gone)) - 1]
        for i, x, y in zip(entry[a].tolist(), inner[a].tolist(), inner[b].tolist()):
            at = entries[i][2]
            keep = at[rank[at] == first[i]]
            spans.append((docs[keep], places[keep] + x, places[keep] + y + length))
    # later places of an entry go whole
    for i, (_, n, at, _) in enumerate(entries):
        later = at[rank[at] > first[i]]
        if len(later):
            spans.append((docs[later], places[later], places[later] + n - 1 + length))
    shared = np.array([x[3] for x in entries])
    stay = np.flatnonzero((least[own] == first[entry]) & shared[entry])
    firsts = []
    for i, x in zip(entry[stay].tolist(), inner[stay].tolist()):
        context, _, at, _ = entries[i]
        k = at[rank[at].argmin()]
        firsts.append((context[x : x + length], int(docs[k]), int(places[k]) + x))
    return spans, firsts


def process(rows: list[tuple[int, bytes, int, int, np.ndarray, np.ndarray, bool]], length: int) -> tuple[list[Span], list[First]]:
    """Rows (anchor hash, context, starts, anchor offset, docs, places, shared) of whole anchors, or of a task's part of
    shared ones -> spans to remove, and firsts."""
    docs, places = np.concatenate([r[4] for r in rows]), np.concatenate([r[5] for r in rows])
    anchors = places + np.repeat([r[3] for r in rows], [len(r[4]) for r in rows])
    by = np.lexsort((anchors, docs))
    new = np.concatenate([[True], (docs[by][1:] != docs[by][:-1]) | (anchors[by][1:] != anchors[by][:-1])])
    rank = np.empty(len(docs), np.int64)
    rank[by] = np.cumsum(new)
    merged: dict[tuple[int, bytes, int, int, bool], list] = defaultdict(list)
    n = 0
    for key, context, starts, offset, d, _, shared in rows:
        merged[(key, context, starts, offset, shared)].append(np.arange(n, n + len(d)))
        n += len(d)
    by_anchor: dict[int, list] = defaultdict(list)
    for (key, context, starts, _, shared), at in merged.items():
        by_anchor[key].append((context, starts, np.concatenate(at) if len(at) > 1 else at[0], shared))
    spans, firsts, mixed = [], [], []
    for found in by_anchor.values():
        if len(found) > 1:
            mixed += found
            continue
        ((context, starts, at, shared),) = found
        first = rank[at].min()
        later = at[rank[at] > first]
        if len(later):
            spans.append((docs[later], places[later], places[later] + starts - 1 + length))
        if shared:
            k = at[rank[at].argmin()]
            firsts += [(context[x : x + length], int(docs[k]), int(places[k]) + x) for x in range(starts)]
    if mixed:
        more, others = _spans(mixed, docs, places, rank, length)
        spans += more
        firsts += others
    return spans, firsts


def _texts(column: pa.Array) -> list[bytes]:
    return [b"" if t is None else t for t in column.cast(pa.large_binary()).to_pylist()]


def later_copies(docs: DataFrame) -> DataFrame:
    """(row, doc, text) -> (row, doc): rows whose whole text a row of an earlier id has."""
    whole = docs.select("row", "doc", F.sha2("text", 256).alias("digest"), F.xxhash64("text").alias("hash")).where("digest IS NOT NULL")
    firsts = whole.groupBy("hash", "digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    return whole.join(firsts.drop("last"), ["hash", "digest"]).where("doc > first").select("row", "doc").distinct()


def repeated_spans(docs: DataFrame, copies: DataFrame, length: int = 100, k: int = K) -> DataFrame:
    """(row, doc, text) -> (row, doc, spans): what goes from rows that are no copies, in parts that may overlap, a row often."""

    def anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, own = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            text, _, _, _, hashed = runs(_texts(batch.column(2)), length, k)
            by = np.lexsort((hashed, text))
            text, hashed = text[by], hashed[by]
            first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (hashed[1:] != hashed[:-1])])) if len(text) else np.zeros(0, int)
            times = np.diff(np.append(first, len(text)))
            yield pa.record_batch([pa.array(hashed[first]), pa.array(ids[text[first]]), pa.array(own[text[first]]), pa.array(times.astype(np.int32))], names=["anchor", "row", "doc", "times"])
        release_memory()

    half = (length - k + 1) // 2

    def contexts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, own, raw = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _texts(batch.column(2))
            wanted = batch.column(3)
            sizes = np.diff(wanted.offsets.to_numpy())
            text, start, n, place, hashed = runs(raw, length, k)
            listed, of, parts = np.repeat(np.arange(len(raw)), sizes), wanted.flatten().field(0).to_numpy(), wanted.flatten().field(1).to_numpy()
            hit = _in_lists(text, hashed, listed, of)
            dealt = {(t, h): m for t, h, m in zip(listed[parts != 1].tolist(), of[parts != 1].tolist(), parts[parts != 1].tolist())}
            held: dict[tuple[int, int, bool, bytes, int, int], tuple[list, list, list]] = {}
            for t, s, m, p, h in zip(text[hit].tolist(), start[hit].tolist(), n[hit].tolist(), place[hit].tolist(), hashed[hit].tolist()):
                many = dealt.get((t, h), 1)
                pieces = [(0, s, m)]
                if many == PARTED:  # starts at least `half` bytes before the anchor, and the others
                    far = min(m, max(0, p - s - half + 1))
                    pieces = [(2 * (crc32(raw[t][p - half : p + k]) >> 2), s, far), (2 * (crc32(raw[t][p : p + length - half + 1]) >> 2) + 1, s + far, m - far)]
                elif many > 1:
                    pieces = [((int(ids[t]) + (p >> 16) * 0x9E3779B1) % many, s, m)]
                for part, at, count in pieces:
                    if count:
                        found = held.setdefault((h, part, many > 1, raw[t][at : at + count - 1 + length], count, p - at), ([], [], []))
                        found[0].append(ids[t])
                        found[1].append(own[t])
                        found[2].append(at)
            keys = list(held)
            for a in range(0, len(keys), 20_000):
                part = keys[a : a + 20_000]
                offsets = pa.array(np.cumsum([0, *[len(held[x][0]) for x in part]]), pa.int32())
                yield pa.record_batch(
                    [
                        *[pa.array([x[i] for x in part], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.int32(), pa.int32()))],
                        pa.ListArray.from_arrays(offsets, pa.array([r for x in part for r in held[x][0]], pa.int64())),
                        pa.ListArray.from_arrays(offsets, pa.array([d for x in part for d in held[x][1]], pa.int64())),
                        pa.ListArray.from_arrays(offsets, pa.array([s for x in part for s in held[x][2]], pa.int32())),
                    ],
                    names=["anchor", "part", "shared", "context", "starts", "offset", "rows", "docs", "places"],
                )
        release_memory()

    def remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        names = ["row", "spans", "start", "doc", "high", "low"]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        held: list = []
        size = 0

        def flush(ready: list) -> Iterator[pa.RecordBatch]:
            if not ready:
                return
            # rows are numbered in the order of their documents
            rows, docs = np.concatenate([x[5] for x in ready]), np.concatenate([x[6] for x in ready])
            by = np.lexsort((rows, docs))
            code = np.empty(len(by), np.int64)
            code[by] = np.cumsum(np.concatenate([[False], (docs[by][1:] != docs[by][:-1]) | (rows[by][1:] != rows[by][:-1])]))
            row_of, doc_of = np.empty(int(code.max()) + 1, np.int64), np.empty(int(code.max()) + 1, np.int64)
            row_of[code], doc_of[code] = rows, docs
            codes = np.split(code, np.cumsum([len(x[5]) for x in ready])[:-1])
            spans, firsts = process([(x[0], x[2], x[3], x[4], c, x[7], x[1]) for x, c in zip(ready, codes)], length)
            if spans:
                d, a, b = (np.concatenate(x) for x in zip(*spans))
                by = np.lexsort((b, a, d))
                d, a, b = d[by], a[by].astype(np.int32), b[by].astype(np.int32)
                edge = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1], [True]]))  # one output row a document
                listed = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.StructArray.from_arrays([pa.array(a), pa.array(b)], ["start", "stop"]))
                empty = pa.nulls(len(listed), pa.int64())
                own = d[edge[:-1]]
                yield pa.record_batch([pa.array(row_of[own]), listed, pa.nulls(len(listed), pa.int32()), pa.array(doc_of[own]), empty, empty], names=names)
            if firsts:
                d, a = np.array([x[1] for x in firsts]), np.array([x[2] for x in firsts], np.int32)
                halves = np.frombuffer(b"".join(xxh3_128_digest(x[0]) for x in firsts), "<i8").reshape(-1, 2)
                yield pa.record_batch([pa.array(row_of[d]), pa.nulls(len(d), kind), pa.array(a), pa.array(doc_of[d]), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())], names=names)

        group = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns[:6]), *batch.columns[6:]):
                if size >= TRANSFORM_BYTES and row[:2] != group:
                    yield from flush(held)
                    held, size = [], 0
                group = row[:2]
                context = row[3]
                size += len(context) + 1 if not held or context != held[-1][2] else 0
                held.append((row[0], row[2], *row[3:6], row[6].values.to_numpy(), row[7].values.to_numpy(), row[8].values.to_numpy().astype(np.int64)))
        yield from flush(held)
        held = []
        release_memory()

    # texts move only where a sieve cannot tell: here those that may be copies, below those with a repeated anchor
    tagged = sieved(docs, copies, "row", "doc", name="_maybe")
    doubtful = tagged.where("_maybe").join(copies, ["row", "doc"], "left_anti")
    own = tagged.where("NOT _maybe").select("row", "doc", "text").union(doubtful.select("row", "doc", "text"))
    grams = own.mapInArrow(anchors, "anchor long, row long, doc long, times int")
    grams = stored(grams, "suffix-anchors")
    often = grams.groupBy("anchor").agg(F.sum("times").alias("n")).where("n > 1")
    parts = F.when(F.col("n") <= HOT, 1).when(F.col("n") <= HOTTEST, PARTED).otherwise(F.ceil(F.col("n") / HOT))
    often = stored(often.select("anchor", parts.cast("int").alias("parts")), "suffix-often")
    # most anchors stand once and need not move
    likely = sieved(grams.select("anchor", "row", "doc"), often, "anchor", name="_maybe").where("_maybe").drop("_maybe")
    marked = likely.join(often, "anchor").groupBy("row", "doc").agg(F.collect_set(F.struct("anchor", "parts")).alias("anchors"))
    marked = stored(marked, "suffix-marked")
    drop_stored(grams)
    drop_stored(often)
    found = sieved(docs, marked, "row", "doc", name="_maybe").where("_maybe").join(marked, ["row", "doc"]).select("row", "doc", "text", "anchors")
    found = found.mapInArrow(contexts, "anchor long, part int, shared boolean, context binary, starts int, offset int, rows array<long>, docs array<long>, places array<int>")
    found = found.repartition("anchor", "part").sortWithinPartitions("anchor", "part", "context")
    schema = "row long, spans array<struct<start:int,stop:int>>, start int, doc long, high long, low long"
    out = stored(found.mapInArrow(remove, schema), "suffix-spans")
    drop_stored(marked)
    # strings that several tasks have seen: all places but the first of each
    firsts = out.where("high IS NOT NULL").select("row", "start", "doc", "high", "low")
    least = firsts.groupBy("high", "low").agg(F.count("*").alias("n"), F.min(F.struct("doc", "row", "start")).alias("least")).where("n > 1")
    again = firsts.join(least, ["high", "low"]).where(F.struct("doc", "row", "start") != F.col("least"))
    later = again.select("row", "doc", F.array(F.struct("start", (F.col("start") + length).alias("stop"))).alias("spans"))
    return out.where("high IS NULL").select("row", "doc", "spans").union(later)


def _in_lists(text: np.ndarray, hashed: np.ndarray, list_text: np.ndarray, list_hash: np.ndarray) -> np.ndarray:
    """Indices of the pairs (text, hashed) that stand among the pairs (list_text, list_hash)."""
    both_text, both_hash = np.concatenate([list_text, text]), np.concatenate([list_hash, hashed])
    by = np.lexsort((np.arange(len(both_text)), both_hash, both_text))
    new = np.concatenate([[True], (both_text[by][1:] != both_text[by][:-1]) | (both_hash[by][1:] != both_hash[by][:-1])]) if len(by) else np.zeros(0, bool)
    listed = by[np.flatnonzero(new)] < len(list_text)  # list pairs come first in their group
    hit = by[listed[np.cumsum(new) - 1]] if len(by) else by
    return np.sort(hit[hit >= len(list_text)]) - len(list_text)


def deduplicate(docs: DataFrame, length: int = 100, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) -> kept (binary), spans (array of start, stop) and n_bytes."""
    doc = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 63)))
    docs = docs.select(doc.alias("doc"), F.col(f"`{text_col}`").alias("text")).select(row_hash("doc", "text").alias("row"), "doc", "text")
    copies = stored(later_copies(docs), "suffix-copies")
    spans = repeated_spans(docs, copies, length, k)
    # a copy goes whole, if it has a string of that length at all
    whole = copies.select("row", "doc", F.array(F.struct(F.lit(0).alias("start"), F.lit((1 << 31) - 1).alias("stop"))).alias("spans"))
    spans = spans.union(whole)
    by_row = spans.groupBy("row", "doc").agg(F.flatten(F.collect_list("spans")).alias("spans"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, united = [], []
            for raw, spans in zip(_texts(batch.column(1)), batch.column(2).to_pylist()):
                whole: list[list[int]] = []
                for start, stop in sorted((s["start"], min(s["stop"], len(raw))) for s in spans or [] if s["start"] + length <= len(raw)):
                    if whole and start <= whole[-1][1]:
                        whole[-1][1] = max(whole[-1][1], stop)
                    else:
                        whole.append([start, stop])
                edges = [0, *[x for w in whole for x in w], len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
                united.append([{"start": a, "stop": b} for a, b in whole])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            yield pa.record_batch([batch.column(0), pa.array(kept, pa.binary()), pa.array(united, kind)], names=["doc", "kept", "spans"])
        release_memory()

    # a text that loses nothing stays where it is
    tagged = sieved(docs, spans, "row", "doc", name="_maybe")
    joined = tagged.where("_maybe").join(by_row, ["row", "doc"], "left").select("doc", "text", "spans")
    joined = joined.union(tagged.where("NOT _maybe").select("doc", "text", F.lit(None).cast(joined.schema["spans"].dataType).alias("spans")))
    out = joined.mapInArrow(cut, "doc long, kept binary, spans array<struct<start:int,stop:int>>")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["stop"] - s["start"]))
    own_id = F.when(F.col("doc") > F.lit(-(1 << 63)), F.col("doc"))
    return out.select(own_id.alias(id_col), "kept", "spans", removed.alias("n_removed"), (F.octet_length("kept") + removed).alias("n_bytes"))

