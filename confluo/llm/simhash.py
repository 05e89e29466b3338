"""SimHash near-duplicates: 64-bit fingerprints that differ in at most 3 bits are linked, links make components.

Words are runs of anything but ASCII white space, A-Z lower-cased; a shingle is k words joined by spaces (all words, if
fewer), hashed with XXH64 and a seed. A bit of the fingerprint is 1 if it is set in over half of the shingle hashes,
repeats included.

Linking. Equal fingerprints are one node from the start (the smallest id stands for all), so copies never meet each
other. Nodes are cut into five blocks of bits; two that differ in at most 3 bits agree on at least two whole blocks, so
each node goes to ten buckets, one for each pair of blocks. A bucket with over CHUNK nodes is dealt out as pairs of
chunks, each a task's work of bounded size; nothing is capped. Within a bucket the comparison is bit-sliced: 64
candidates at a time, their bits stored as vertical planes, distances of all of them counted by carry-save counters
that saturate above the radius, and a block is abandoned once all its 64 candidates exceed it. Of the links of a
bucket only a spanning forest leaves the task. Components are the fixed point of label propagation with pointer
jumping over those links, as Spark joins; every round ends in a table in the shared folder.

Defined cases: null and empty texts and texts of white space have fingerprint 0, linked like any other; a null id is a
document of its own that is linked as any other, and it never names a component unless all of the component's ids are
null (component_id is then null); repeated rows fall into one component; an empty table gives an empty table; columns of the input named like
those added are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluo.llm.common import drop_stored, sieved, stored, without

CHUNK = 4096
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: str | None, k: int, seed: int) -> Iterator[np.ndarray]:
    """The hashes of all shingles in their order, at most 4096 at a time; none for a text without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()  # bytes.split: ASCII white space
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - k + 1)
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[min(k, len(words)) - 1 :].tolist()
    for a in range(0, n, 4096):  # bounded memory for very long texts
        yield np.array([xxh64_intdigest(joined[s:e], seed) for s, e in zip(starts[a : a + 4096], stops[a : a + 4096])], "<u8")


def simhash(text: str | None, k: int = 3, seed: int = 42) -> int:
    counts, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, k, seed):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", k: int = 3, seed: int = 42) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(t, k, seed) for t in texts], np.uint64).view(np.int64))

    return of(docs[text])


def _bucket_keys(fp: Column) -> Column:
    """For each pair of blocks a number that holds the pair and the bits of both."""
    keys = []
    for n, ((a, wa), (b, wb)) in enumerate(combinations(BLOCKS, 2)):
        bits_a = F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << wa) - 1))
        bits_b = F.shiftrightunsigned(fp, b).bitwiseAND(F.lit((1 << wb) - 1))
        keys.append(F.lit(n << 32) + F.shiftleft(bits_a, 16) + bits_b)
    return F.array(*keys)


def _planes(words: np.ndarray) -> np.ndarray:
    """(n, 64) fingerprints -> (64, n): plane b of a word holds bit b of its 64 candidates."""
    bits = np.unpackbits(words.view(np.uint8).reshape(len(words), 64, 8), axis=2, bitorder="little")  # word, candidate, bit
    return np.ascontiguousarray(np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")).view("<u8")[:, :, 0]


def within_radius(queries: np.ndarray, blocks: np.ndarray, query: np.ndarray, block: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For pairs (queries[query], blocks[block]) of a fingerprint and a block of 64: the pairs (as an index) and the
    64-bit masks of candidates within the radius, for blocks that have any."""
    planes = _planes(blocks)
    live = np.arange(len(query))
    depth = (radius + 1).bit_length()
    counters = [np.zeros(len(query), np.uint64) for _ in range(depth)]
    over = np.zeros(len(query), np.uint64)
    for b in range(64):
        flip = np.uint64(0) - ((queries[query[live]] >> np.uint64(b)) & np.uint64(1))
        carry = planes[b][block[live]] ^ flip
        for i in range(depth):
            counters[i], carry = counters[i] ^ carry, counters[i] & carry
        over |= carry
        if b % 8 == 7 and b >= 15:
            # beyond the radius: the counter's value is above it, or it has run over
            above = over.copy()
            for value in range(radius + 1, 1 << depth):
                same = ~np.zeros(len(live), np.uint64)
                for i in range(depth):
                    same &= counters[i] if value >> i & 1 else ~counters[i]
                above |= same
            over = above
            keep = over != ~np.uint64(0)
            if not keep.all():
                live, over, counters = live[keep], over[keep], [c[keep] for c in counters]
            if not len(live):
                break
    return live, ~over


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes reaches over the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _link_group(fp: np.ndarray, side: np.ndarray, bucket: np.ndarray, radius: int, most: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """fp sorted by bucket -> links (a, b) of a spanning forest. side 0 meets all of its bucket, 1 only side 0."""
    n = len(fp)
    new = np.concatenate([[True], bucket[1:] != bucket[:-1]])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, n))
    blocks_of = -(-size // 64)
    block_start = np.cumsum(blocks_of) - blocks_of
    group = np.cumsum(new) - 1
    slot = block_start[group] * 64 + (np.arange(n) - first[group])
    padded = np.zeros(int(blocks_of.sum()) * 64, np.uint64)
    owner = np.full(len(padded), -1, np.int64)
    padded[slot], owner[slot] = fp, np.arange(n)
    blocks = padded.reshape(-1, 64)
    # node i meets the blocks of its bucket from its own on; earlier ones have met it
    own_block = slot // 64
    last_block = block_start[group] + blocks_of[group]
    askers = np.flatnonzero((side == 0) & (size[group] > 1))
    label = np.arange(n)
    steps = last_block[askers] - own_block[askers]
    edges = np.concatenate([[0], np.cumsum(steps)])
    at = 0
    while at < len(askers):
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + most, side="right")) - 1)
        part, count = askers[at:to], steps[at:to]
        query = np.repeat(part, count)
        block = np.repeat(own_block[part], count) + np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count)
        pair, masks = within_radius(fp, blocks, query, block, radius)
        hit = np.unpackbits(masks.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, lane = np.nonzero(hit)
        a, b = query[pair[row]], owner[block[pair[row]] * 64 + lane]
        good = (b >= 0) & (b != a)
        label = _forest(n, np.concatenate([np.arange(n), a[good]]), np.concatenate([label, b[good]]))
        at = to
    child = np.flatnonzero(label != np.arange(n))
    return fp[child], fp[label[child]]


def links(nodes: DataFrame, radius: int = 3) -> DataFrame:
    """(fp) distinct -> (a, b): links whose components are those of all pairs within the radius (at most 3)."""
    keyed = nodes.select("fp", F.explode(_bucket_keys(F.col("fp"))).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    keyed = keyed.join(sizes, "key")
    # a bucket of c chunks becomes its pairs of chunks (i, j), i <= j: chunk i asks, chunk j answers
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("fp"), chunks).cast("int")
    dealt = keyed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    dealt = dealt.select(
        "fp", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"),
    )
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "fp")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0

        def compare(table: pa.Table) -> pa.RecordBatch:
            fp = table.column("fp").to_numpy().view(np.uint64)
            side = table.column("side").to_numpy()
            parts = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j")])
            new = np.concatenate([[False], (parts[:, 1:] != parts[:, :-1]).any(axis=0)])
            a, b = _link_group(fp, side, np.cumsum(new), radius)
            return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        def whole_groups(table: pa.Table) -> int:
            """Rows before the last group of the table, which may go on in the next batch."""
            parts = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j")])
            other = np.flatnonzero((parts != parts[:, -1:]).any(axis=0))
            return int(other[-1]) + 1 if len(other) else 0

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows >= 1 << 16:
                table = pa.concat_tables(held).combine_chunks()
                cut = whole_groups(table)
                if cut:
                    yield compare(table.slice(0, cut))
                held, rows = [table.slice(cut)], table.num_rows - cut
        if rows:
            yield compare(pa.concat_tables(held).combine_chunks())

    return dealt.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, label): every node that has an edge with the least node it reaches.

    Each round every node takes the least label around it and the label of its label, so chains halve. Labels only fall,
    so the rounds end.
    """
    both = stored(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a")).where("x <> y").distinct(), "simhash-edges")
    labels = stored(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("label")), "simhash-labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("y"), "label"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("near"))
        jump = labels.join(labels.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", "left")
        new = jump.join(around, "node", "left").select(
            "node", F.least("label", F.coalesce("next", "label"), F.coalesce("near", "label")).alias("new"), "label"
        )
        new = stored(new.select("node", F.col("new").alias("label"), (F.col("new") < F.col("label")).alias("moved")), "simhash-labels")
        drop_stored(labels)
        labels = new
        if labels.where("moved").isEmpty():
            drop_stored(both)
            return labels.select("node", "label")


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", k: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """The input's columns but its text, with fp (64 bits as a long), fingerprint (hex), component (the least fp of the
    component, as a long) and component_id (the least id)."""
    if not 0 <= radius <= 3:
        raise ValueError("the blocks find pairs that differ in at most 3 bits")
    kept = without(docs, "fp", "fingerprint", "component", "component_id")
    prints = stored(kept.withColumn("fp", fingerprints(kept, text, k, seed)).drop(text), "simhash-prints")
    nodes = stored(prints.groupBy("fp").agg(F.min(id_col).alias("rep")), "simhash-nodes")
    edges = stored(links(nodes.select("fp"), radius), "simhash-links")
    labels = components(edges)
    linked = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("label", "fp").alias("component"))
    linked = stored(linked, "simhash-linked")
    named = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    found = stored(linked.drop("rep").join(named, "component"), "simhash-components")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(found, "fp").withColumn("fingerprint", hexed)


def keep_one(docs: DataFrame, text: str = "text", id_col: str = "doc_id", grouped: Callable[..., DataFrame] = near_duplicates) -> DataFrame:
    """docs less all but one document of each component that grouped() finds: of the smallest id, of several such of the
    first text hash, and of these of the first hash of all columns; rows equal in all columns are interchangeable."""
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]  # maps have no hash
    key = [F.col(f"`{id_col}`").alias("_id"), F.xxhash64(F.col(f"`{text}`")).alias("_hash"), F.xxhash64(*hashed).alias("_row")]
    # keys without nulls, so that the join and the search for repeated rows share one exchange of the texts
    safe = [F.col("_id").isNull().alias("_null"), F.coalesce(F.col("_id").cast("string"), F.lit("")).alias("_name")]
    names = ["_null", "_name", "_hash", "_row"]
    found = stored(grouped(docs.select(*key, F.col(f"`{text}`").alias("text")), id_col="_id").select("component", "_id", "_hash", "_row", *safe), "keep-found")
    groups = found.groupBy("component").agg(F.count("*").alias("n"), F.min(F.struct("_null", "_id", "_hash", "_row", "_name")).alias("s")).where("n > 1")
    groups = stored(groups, "keep-groups")
    together = found.join(groups.select("component"), "component", "left_semi").select(*names).distinct()
    gone = together.join(groups.select("s._null", "s._name", "s._hash", "s._row"), names, "left_anti")
    # rows that are alone in their component stay where they are; of the others the first stays, once
    tagged = sieved(docs.select("*", *key).select("*", *safe), together, *names, name="_maybe")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    firsts = tagged.where("_maybe").join(gone, names, "left_anti").dropDuplicates(names)
    return tagged.where("NOT _maybe").select(*columns).union(firsts.select(*columns))
