"""Cross-tokenizer alignment: where two tokenizers' tokens end at the same byte, and how often tokens meet there.

A is a byte-level BPE vocabulary of `tokenizers`, B a BPE model of `sentencepiece`; both read a space and the text, and
special tokens in a text are plain text. Byte offsets where a token of A and one of B end cut a document into groups;
within a group every token of A is linked to every token of B. A pair of ids counts as often as documents hold it.

1. Documents are stored once with a block number, BLOCK rows a block. The first pass aligns them and gives each
   block's distinct pairs with their numbers of documents, dealt to shards by the id of A. So a shard has at most
   (ids of A in it) * (ids of B) pairs, whatever the corpus holds.
2. A tree of unions gives each shard's distinct pairs, and a minimal perfect hash of them: levels of bits; a pair stands
   where it is alone in its level, its index is the number of set bits before it.
3. Each block's numbers become dense vectors by that index, which a tree of sums adds up.
4. Every block asks the shards for its own pairs. A pair is taken only if the key stored at its index is the same.
5. The second pass aligns the documents again, with their block's answers beside them.

No task holds more than a block of documents, FAN partial results of a shard, or one shard; nothing passes the driver.

Defined cases: documents whose text is null or empty, or not spelled by the tokens of both (a U+2581, which B reads as
a space), have no tokens: zeros and empty groups. Any length of text is aligned whole; large groups are expanded over
distinct ids, in slices. Repeated rows and ids, and rows without an id, are documents of their own; an empty table gives
an empty table; columns of the input named like those added are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from confluo.llm.bpe import ByteBPE, Words, flat_ranges, pooled, vocabulary
from confluo.llm.common import stored, without

BLOCK, SHARDS, FAN = 256, 64, 128
SLICE = 4_000_000
_BITS = 20  # ids are below 1 << 20


class Pieces:
    """A sentencepiece BPE model whose pieces hold spaces only in front: stretches of spaces and what follows them are
    encoded apart, each distinct one once."""

    def __init__(self, path: str, most_words: int = 1_000_000):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("▁" in n.lstrip("▁") for n in names):
            raise ValueError("a piece has a space that is not in front")
        spelled = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.size = len(names)
        self.space = self.model.piece_to_id("▁")
        self.lengths = np.array([len(x) for x in spelled], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)
        self.words = Words(self._encode_stretches, most_words)

    def _encode_stretches(self, buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # the model itself puts the first space in front
        texts = [buffer[a:b].tobytes().decode() for a, b in zip((starts + 1).tolist(), (starts + lengths).tolist())]
        found = [ids or [self.space] for ids in self.model.encode(texts, num_threads=1)]
        return np.array([i for ids in found for i in ids], np.int64), np.array([len(ids) for ids in found], np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids one after the other, number of ids of each text, whether the ids spell a space and the text)."""
        raw = [(" " + t).encode() for t in texts]
        buffer = np.frombuffer(b"".join(raw), np.uint8)
        sizes = np.array([len(r) for r in raw])
        space = buffer == 32
        first = space.copy()
        first[1:] &= ~space[:-1]
        first[np.cumsum(sizes) - sizes] = True
        starts = np.flatnonzero(first)
        ids, per_word = self.words.look_up(buffer, starts, np.diff(np.append(starts, len(buffer))))
        before = np.concatenate([[0], np.cumsum(per_word)])
        stops = before[np.searchsorted(starts, np.cumsum(sizes))]
        counts = np.diff(np.concatenate([[0], stops]))
        spelled = self.bytes[flat_ranges(self.begins[ids], self.lengths[ids])].tobytes()
        ends = np.concatenate([[0], np.cumsum(self.lengths[ids])])[stops].tolist()
        good = np.array([spelled[a:b] == r for a, b, r in zip([0, *ends], ends, raw)], bool)
        bad = [i for i in np.flatnonzero(~good) if "▁" not in texts[i]]
        if bad:  # two stretches of one hash, or a text that the model changes
            split = np.split(ids, stops[:-1])
            for i in bad:
                split[i] = np.array(self.model.encode(texts[i]), np.int64)
                counts[i] = len(split[i])
                good[i] = self.bytes[flat_ranges(self.begins[split[i]], self.lengths[split[i]])].tobytes() == raw[i]
            ids = np.concatenate(split)
        return ids, counts, good


_models: dict[str, Pieces] = {}


def _tokenizers(path_a: str, path_b: str) -> tuple[ByteBPE, Pieces]:
    if path_b not in _models:
        _models[path_b] = Pieces(path_b)
    return vocabulary(path_a), _models[path_b]


class Aligned:
    """The groups of many documents. Tokens of documents without groups are left out."""

    def __init__(self, texts: list[str], a: ByteBPE, b: Pieces):
        ids_b, n_b, good = b.encode(texts)
        ids_a, n_a, _ = a.encode_checked([" " + t for t in texts], special=False)
        good &= np.array([t != "" for t in texts], bool)
        self.a, self.b = ids_a[np.repeat(good, n_a)], ids_b[np.repeat(good, n_b)]
        self.n_a, self.n_b = n_a * good, n_b * good
        end_a, end_b = np.cumsum(a.lengths[self.a]), np.cumsum(b.lengths[self.b])
        near = np.minimum(np.searchsorted(end_b, end_a), max(0, len(end_b) - 1))
        shared = end_a[end_b[near] == end_a]
        self.first_a = np.concatenate([[0], np.searchsorted(end_a, shared) + 1])  # of each group, and the end
        self.first_b = np.concatenate([[0], np.searchsorted(end_b, shared) + 1])
        # a document's end is always shared, so its groups are whole
        stops = np.searchsorted(self.first_a, np.cumsum(self.n_a))
        self.n_groups = np.diff(np.concatenate([[0], stops]))
        self.doc = np.repeat(np.arange(len(texts)), self.n_groups)
        links = np.diff(self.first_a) * np.diff(self.first_b)
        self.n_links = np.zeros(len(texts), np.int64)
        np.add.at(self.n_links, self.doc, links)
        self.links = links

    def _slices(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(document, a, b, links) of linked ids, not yet distinct."""
        size_a, size_b = np.diff(self.first_a), np.diff(self.first_b)
        large = self.links > 4096
        one = np.repeat(~large, size_a)
        yield from self._product(self.doc[~large], size_a[~large], self.a[one], None, size_b[~large], self.b[np.repeat(~large, size_b)], None)
        for g in np.flatnonzero(large):
            a, times_a = np.unique(self.a[self.first_a[g] : self.first_a[g + 1]], return_counts=True)
            b, times_b = np.unique(self.b[self.first_b[g] : self.first_b[g + 1]], return_counts=True)
            yield from self._product(self.doc[g : g + 1], np.array([len(a)]), a, times_a, np.array([len(b)]), b, times_b)

    @staticmethod
    def _product(doc, size_a, a, times_a, size_b, b, times_b) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        partners = np.repeat(size_b, size_a)  # of each token of A
        begin = np.repeat(np.cumsum(size_b) - size_b, size_a)
        docs = np.repeat(doc, size_a)
        made = np.cumsum(partners)
        cuts = [0, *np.searchsorted(made, np.arange(SLICE, int(made[-1]) if len(made) else 0, SLICE)).tolist(), len(a)]
        for x, y in zip(cuts, cuts[1:]):
            if y > x:
                n = partners[x:y]
                other = flat_ranges(begin[x:y], n)
                times = np.ones(len(other), np.int64) if times_a is None else np.repeat(times_a[x:y], n) * times_b[other]
                yield np.repeat(docs[x:y], n), np.repeat(a[x:y], n), b[other], times

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, pair, links), one row for each pair of a document, sorted."""
        keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for doc, a, b, n in self._slices():
            held.append(_summed((doc << 2 * _BITS) | (a << _BITS) | b, n))
        if len(held) == 1:
            keys, times = held[0]
        elif held:
            keys, times = _summed(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))
        return keys >> 2 * _BITS, keys & ((1 << 2 * _BITS) - 1), times

    def spelled(self) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` of each document."""
        n_a, n_b = len(self.a), len(self.b)
        if not n_a:
            return [""] * len(self.n_a)
        size_a, size_b = np.diff(self.first_a), np.diff(self.first_b)
        ids, marks = np.empty(n_a + n_b, np.int64), np.full(n_a + n_b, ord(","), np.uint8)
        at_a = np.arange(n_a) + np.repeat(self.first_b[:-1], size_a)
        at_b = np.arange(n_b) + np.repeat(self.first_a[1:], size_b)
        ids[at_a], ids[at_b] = self.a, self.b
        marks[at_a[self.first_a[1:] - 1]], marks[at_b[self.first_b[1:] - 1]] = ord("|"), ord(";")
        digits = np.zeros((len(ids), 8), np.uint8)  # right-aligned, then the mark
        width = np.ones(len(ids), np.int64)
        for k in range(1, 7):
            width += ids >= 10**k
        for k in range(7):
            digits[:, 6 - k] = ids // 10**k % 10 + 48
        digits[:, 7] = marks
        raw = digits[np.arange(8) >= (7 - width)[:, None]].tobytes()
        stops = np.concatenate([[0], np.cumsum(width + 1)])[np.cumsum(self.n_a + self.n_b)].tolist()
        return [raw[x : y - 1].decode() if y > x else "" for x, y in zip([0, *stops], stops)]


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their values."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(values[order], first) if len(keys) else values


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class MinimalHash:
    """Numbers 0 ... n - 1 for n distinct keys, in about three bits a key."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.before = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])

    @staticmethod
    def build(keys: np.ndarray) -> MinimalHash:
        sizes, levels = [], []
        while len(keys):
            at = (_mixed(keys, len(sizes)) % np.uint64(2 * len(keys))).astype(np.int64)
            many = np.bincount(at, minlength=2 * len(keys))
            sizes.append(2 * len(keys))
            levels.append(many == 1)
            keys = keys[many[at] > 1]
        return MinimalHash(sizes, np.concatenate(levels) if levels else np.zeros(0, bool))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Of a key that is not among them any number, or -1."""
        out = np.full(len(keys), -1, np.int64)
        live, offset = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = offset + (_mixed(keys[live], level) % np.uint64(size)).astype(np.int64)
            hit = self.bits[at]
            out[live[hit]] = self.before[at[hit]]
            live, offset = live[~hit], offset + size
        return out


_PARTIAL = pa.schema([("shard", pa.int32()), ("lane", pa.int64()), ("value", pa.binary())])


def _longs(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i8")


def _tree(rows: DataFrame, lanes: int, combine: Callable[[list[np.ndarray]], np.ndarray], name: str) -> DataFrame:
    """(shard, lane, value) -> one row for each shard: a lane's values are combined, then those of FAN lanes at a time."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        value = combine([_longs(v) for v in table["value"].to_pylist()])
        return pa.table({"shard": [key[0].as_py()], "lane": [key[1].as_py()], "value": [value.astype("<i8").tobytes()]}, schema=_PARTIAL)

    while True:
        rows = rows.withColumn("lane", F.col("lane") % lanes).groupBy("shard", "lane").applyInArrow(run, "shard int, lane long, value binary")
        if lanes == 1:
            return stored(rows.drop("lane"), name)
        lanes = -(-lanes // FAN)


def _numbered(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The first pass: (block, lane, shard, keys, docs) of the stored documents, keys and docs as longs in bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _tokenizers(path_a, path_b)
        for batch in batches:
            blocks = batch.column(0).to_numpy()
            for first, texts in pooled(batch, 1):
                own = blocks[first : first + len(texts)]
                doc, pair, _ = Aligned(texts, a, b).pairs()
                for block in np.unique(own).tolist():
                    pairs, docs = np.unique(pair[own[doc] == block], return_counts=True)
                    shards = _shard(pairs >> _BITS)
                    order = np.argsort(shards, kind="stable")
                    found, begin = np.unique(shards[order], return_index=True)
                    cut = lambda x: [p.astype("<i8").tobytes() for p in np.split(x[order], begin[1:])] if len(found) else []  # noqa: B023,E731
                    yield pa.record_batch([pa.array([block] * len(found), pa.int64()), pa.array(found, pa.int32()), pa.array(cut(pairs), pa.binary()), pa.array(cut(docs), pa.binary())], names=["block", "shard", "keys", "docs"])

    return docs.select("_block", "_text").mapInArrow(run, "block long, shard int, keys binary, docs binary")


def _shard(ids: np.ndarray) -> np.ndarray:
    return (_mixed(ids, 99) % np.uint64(SHARDS)).astype(np.int32)


def _by_lane(of_shard: DataFrame, lanes: int) -> DataFrame:
    return of_shard.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))))


def _hash_of(table: pa.Table) -> tuple[MinimalHash, np.ndarray]:
    row = table.slice(0, 1).to_pylist()[0]
    bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8))[: sum(row["sizes"])].astype(bool)
    return MinimalHash(row["sizes"], bits), _longs(row["keys"])


def _hashed(keys: DataFrame) -> DataFrame:
    """(shard, value: distinct pairs) -> (shard, sizes, bits, keys: the pairs by their index)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pairs = _longs(raw)
                made = MinimalHash.build(pairs)
                by_index = np.empty(len(pairs), "<i8")
                by_index[made.index(pairs)] = pairs
                yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([made.sizes], pa.list_(pa.int64())), pa.array([np.packbits(made.bits).tobytes()], pa.binary()), pa.array([by_index.tobytes()], pa.binary())], names=["shard", "sizes", "bits", "keys"])

    return keys.select("shard", "value").mapInArrow(run, "shard int, sizes array<long>, bits binary, keys binary")


def pair_counts(blocks: DataFrame, n_blocks: int) -> DataFrame:
    """(block, shard, keys, docs) -> (block, keys, counts, best): for each block's pairs how many documents of all hold
    them, and whether that is the most of any pair with the same id of A."""
    lanes = -(-n_blocks // FAN)
    blocks = blocks.withColumn("lane", F.pmod(F.xxhash64("block"), F.lit(lanes)))
    union = _tree(blocks.select("shard", "lane", F.col("keys").alias("value")), lanes, lambda parts: np.unique(np.concatenate(parts)), "align-keys")
    hashes = stored(_hashed(union), "align-hashes")

    def dense(key: tuple, rows: pa.Table, table: pa.Table) -> pa.Table:
        made, keys = _hash_of(table)
        vector = np.zeros(len(keys), "<i8")
        pairs, docs = (_longs(b"".join(rows[c].to_pylist())) for c in ("keys", "docs"))
        np.add.at(vector, _verified(made, keys, pairs), docs)
        return pa.table({"shard": [key[0].as_py()], "lane": [key[1].as_py()], "value": [vector.tobytes()]}, schema=_PARTIAL)

    vectors = blocks.groupBy("shard", "lane").cogroup(_by_lane(hashes, lanes).groupBy("shard", "lane")).applyInArrow(dense, "shard int, lane long, value binary")
    counts = _tree(vectors, -(-lanes // FAN), lambda parts: np.sum(parts, axis=0), "align-counts")
    answers = _by_lane(hashes.join(counts.withColumnRenamed("value", "counts"), "shard"), lanes)

    def answer(key: tuple, rows: pa.Table, table: pa.Table) -> pa.Table:
        made, keys = _hash_of(table)
        counts = _longs(table["counts"][0].as_py())
        a, group = np.unique(keys >> _BITS, return_inverse=True)
        most = np.zeros(len(a), np.int64)
        np.maximum.at(most, group, counts)
        best = counts == most[group]
        asked = rows["keys"].to_pylist()
        index = _verified(made, keys, _longs(b"".join(asked)))
        found = np.split(index, np.cumsum([len(x) // 8 for x in asked])[:-1])[: len(asked)]  # none for a lane that asks nothing
        return pa.table({"block": rows["block"], "keys": rows["keys"], "counts": pa.array([counts[i].astype("<i8").tobytes() for i in found], pa.binary()), "best": pa.array([best[i].tobytes() for i in found], pa.binary())})

    asked = blocks.groupBy("shard", "lane").cogroup(answers.groupBy("shard", "lane"))
    return asked.applyInArrow(answer, "block long, keys binary, counts binary, best binary")


def _verified(made: MinimalHash, keys: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    index = made.index(pairs)
    if (index < 0).any() or (keys[index] != pairs).any():
        raise ValueError("a pair of the documents has no entry")
    return index


ADDED = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """The input's columns but its text, with n_a, n_b, n_groups, n_links, n_best, count_sum and groups."""
    kept = without(docs, *ADDED, "groups", "_block", "_text")
    rest = [c for c in kept.columns if c != text]
    number = F.monotonically_increasing_id()  # partition and place in it; what comes of it is stored with the rows
    block = F.shiftright(number, 33) * (1 << 24) + F.floor(number.bitwiseAND(F.lit((1 << 33) - 1)) / BLOCK)
    rows = stored(kept.select(F.col(f"`{text}`").alias("_text"), block.alias("_block"), *[F.col(f"`{c}`") for c in rest]), "align-documents")
    n_blocks = rows.select("_block").distinct().count()
    asked = stored(_numbered(rows, path_a, path_b), "align-pairs")
    answers = pair_counts(asked, max(1, n_blocks))
    fields = [*[kept.schema[c] for c in rest], *[T.StructField(c, T.LongType()) for c in ADDED], T.StructField("groups", T.StringType())]

    def run(key: tuple, table: pa.Table, known: pa.Table) -> pa.Table:
        a, b = _tokenizers(path_a, path_b)
        keys = np.concatenate([_longs(x) for x in known["keys"].to_pylist()] or [np.zeros(0, np.int64)])
        counts = np.concatenate([_longs(x) for x in known["counts"].to_pylist()] or [np.zeros(0, np.int64)])
        best = np.concatenate([np.frombuffer(x, bool) for x in known["best"].to_pylist()] or [np.zeros(0, bool)])
        order = np.argsort(keys)
        keys, counts, best = keys[order], counts[order], best[order]
        parts = []
        for batch in table.to_batches():
            for first, texts in pooled(batch, batch.schema.get_field_index("_text")):
                found = Aligned(texts, a, b)
                doc, pair, links = found.pairs()
                at = np.searchsorted(keys, pair)
                n_best, total = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
                np.add.at(n_best, doc, links * best[at])
                np.add.at(total, doc, links * counts[at])
                own = [batch.column(c).slice(first, len(texts)) for c in rest]
                parts.append(pa.record_batch([*own, *map(pa.array, (found.n_a, found.n_b, found.n_groups, found.n_links, n_best, total)), pa.array(found.spelled(), pa.string())], names=[*rest, *ADDED, "groups"]))
        return pa.Table.from_batches(parts)

    both = rows.groupBy("_block").cogroup(answers.withColumnRenamed("block", "_block").groupBy("_block"))
    return both.applyInArrow(run, T.StructType(fields))
