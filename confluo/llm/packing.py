"""Packing tokenised documents into training sequences, balanced by attention cost.

Each task reads its documents once, tokenises them, and packs them in pools of about pool_tokens tokens, so nothing is
shuffled and memory is bounded. A document longer than a sequence first gives full sequences of its own. The rest of
each pool is placed in descending length: a piece goes to the sequence of lowest estimated cost, linear * n plus
quadratic * n**2 summed over its pieces, among those with room for it. Where none has room for the whole, the piece is
cut at the lowest-cost sequence with remaining capacity and its rest is placed next. The slots of a pool add up to
exactly its tokens: sequences of `capacity`, and a tail of sequences whose sizes are powers of two, so none is padded.

Tokens are those of the `tokenizers` library. Its words do not depend on each other, so each distinct word is given to
it once and remembered; texts are cut into words in numpy. Texts with special tokens, or with characters for which the
two libraries might disagree, go to the tokenizer whole.

Defined cases: a null or empty text is one end token; any length of text is packed, cut into pieces; repeated rows and
rows of one id, or without one, are documents of their own; pieces of equal length are placed in the order of their
documents, sequences of equal cost in their own; an empty table gives an empty table; other columns of the input, also
those named like the result's, are not carried.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from confluo.llm.common import release_memory

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
ARROW_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

_SPACE, _LETTER, _DIGIT, _OTHER, _UNSAFE = range(5)
_LONGEST_HASHED = 64
SLICE_CHARS = 1 << 19


def _char_classes() -> np.ndarray:
    """The pre-tokenizer's class of each UTF-16 unit; unsafe where libraries may differ in case or normal forms."""
    import regex

    table = np.full(1 << 16, _UNSAFE, np.uint8)
    safe = [*range(0x20, 0x7F), 9, 10, 11, 12, 13, *range(0xA1, 0xAD), *range(0xAE, 0x130), *range(0x131, 0x180), *range(0x2010, 0x2028), *range(0x2030, 0x205F), 0x20AC]
    for c in safe:
        ch = chr(c)
        table[c] = _SPACE if ch in " \t\n\x0b\x0c\r" else _LETTER if regex.fullmatch(r"\p{L}", ch) else _DIGIT if regex.fullmatch(r"\p{N}", ch) else _OTHER
    return table


class WordTokenizer:
    """tokenizers' ids for whole texts, with each distinct word tokenised once."""

    def __init__(self, path: str, most_words: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.classes = _char_classes()
        self.most_words = most_words
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted hashes of known words
        self.lengths = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint16 if len(self.ends) <= 1 << 16 else np.uint32)

    def _word_starts(self, units: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words start, and where they end."""
        before = np.empty_like(classes)
        before[0] = _SPACE
        before[1:] = classes[:-1]
        starts = (classes != _SPACE) & ((classes != before) | (classes == _DIGIT))
        quotes = np.flatnonzero((units[:-1] == 39) & (before[:-1] != _OTHER) & (classes[1:] == _LETTER))
        if len(quotes):  # 's 't 'm 'd 're 've 'll after a lone quote are words
            padded = np.concatenate([units, np.zeros(3, units.dtype)])
            one, two = padded[quotes + 1], padded[quotes + 2]
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
            for found, k in ((quotes[short], 2), (quotes[long], 3)):
                starts[found + 1] = False
                after = found + k
                after = after[after < len(units)]
                starts[after[classes[after] == _LETTER]] = True
        first = np.flatnonzero(starts)
        # a word ends at the next space or the next start
        stops = np.flatnonzero(starts | (classes == _SPACE))
        last = np.append(stops, len(units))[np.searchsorted(stops, first, side="right")]
        return first, last

    def _hashes(self, units: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """A 64-bit polynomial hash of each word of at most _LONGEST_HASHED units."""
        out = np.full(len(first), 0x9E3779B97F4A7C15, np.uint64) ^ lengths.astype(np.uint64)
        order = np.argsort(lengths, kind="stable")
        sizes = lengths[order]
        at, value = first[order], out[order]
        with np.errstate(over="ignore"):
            for k in range(int(sizes[-1])):
                live = np.searchsorted(sizes, k, side="right")
                value[live:] = (value[live:] ^ units[at[live:] + k]) * np.uint64(0x100000001B3) + np.uint64(0x632BE59BD9B4E019)
        value ^= value >> np.uint64(29)
        out[order] = value
        return out

    def _learn(self, words: list[str], keys: np.ndarray) -> None:
        # one encoding at a time, as it takes over a hundred bytes a token
        parts = (self.tokenizer.encode(" ".join(words[i : i + 1000]), add_special_tokens=False) for i in range(0, len(words), 1000))
        ids = np.concatenate([np.array(e.ids, self.ids.dtype) for e in parts])
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words):
            raise ValueError("the tokenizer does not end each word with one end-of-word token")
        starts = np.concatenate([[0], stops[:-1]])
        order_keys = np.concatenate([self.keys, keys])
        order = np.argsort(order_keys, kind="stable")
        self.keys = order_keys[order]
        self.starts = np.concatenate([self.starts, starts + len(self.ids)])[order]
        self.lengths = np.concatenate([self.lengths, stops - starts])[order]
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the number of ids of each text; about SLICE_CHARS characters at a time, as
        the arrays made on the way take many times the memory of the texts."""
        found, lo, chars = [], 0, 0
        for i, x in enumerate(texts):
            chars += len(x) + 1
            if chars >= SLICE_CHARS or i == len(texts) - 1:
                found.append(self._encode(texts[lo : i + 1]))
                lo, chars = i + 1, 0
        ids, counts = zip(*found) if found else ((self.ids[:0],), (np.zeros(0, np.int64),))
        return np.concatenate(ids), np.concatenate(counts)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        counts = np.zeros(len(texts), np.int64)
        parts: list[np.ndarray | None] = [None] * len(texts)
        units = [np.frombuffer(x.lower().encode("utf-16-le", "surrogatepass"), np.uint16) for x in texts]
        classes = [self.classes[u] for u in units]
        safe = [i for i, c in enumerate(classes) if len(c) and c.max() < _UNSAFE and "<|" not in texts[i]]
        plain = set(safe)
        for i in range(len(texts)):
            if i not in plain and texts[i]:
                parts[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, self.ids.dtype)
        if safe:
            gap_u, gap_c = np.full(1, 10, np.uint16), np.full(1, _SPACE, np.uint8)
            all_u = np.concatenate([x for i in safe for x in (units[i], gap_u)])
            all_c = np.concatenate([x for i in safe for x in (classes[i], gap_c)])
            first, last = self._word_starts(all_u, all_c)
            ids, per_word = self._word_ids(all_u, first, last - first)
            ends = np.cumsum([len(units[i]) + 1 for i in safe])
            word_stop = np.searchsorted(first, ends)
            token_stop = np.concatenate([[0], np.cumsum(per_word)])[word_stop]
            for i, a, b in zip(safe, np.concatenate([[0], token_stop[:-1]]), token_stop):
                parts[i] = ids[a:b]
        for i, p in enumerate(parts):
            counts[i] = 0 if p is None else len(p)
        known = [p for p in parts if p is not None]
        return (np.concatenate(known) if known else self.ids[:0]), counts

    def _word_ids(self, units: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(first):
            return self.ids[:0], lengths
        if len(self.keys) > self.most_words:
            self._forget()
        short = lengths <= _LONGEST_HASHED
        keys = np.zeros(len(first), np.uint64)
        if short.any():
            keys[short] = self._hashes(units, first[short], lengths[short])
        distinct, one, where = np.unique(keys, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, distinct), max(0, len(self.keys) - 1))
        new = np.ones(len(distinct), bool) if not len(self.keys) else self.keys[at] != distinct
        new &= short[one]
        text = lambda k: units[first[k] : first[k] + lengths[k]].tobytes().decode("utf-16-le")
        if new.any():
            self._learn([text(k) for k in one[new]], distinct[new])
        at = np.minimum(np.searchsorted(self.keys, distinct), max(0, len(self.keys) - 1))[where]
        per_word, starts, ids = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64), self.ids
        if short.any():
            per_word[short], starts[short] = self.lengths[at[short]], self.starts[at[short]]
        for k in np.flatnonzero(~short):  # rare words of over 64 characters
            own = np.array(self.tokenizer.encode(text(k), add_special_tokens=False).ids, self.ids.dtype)
            per_word[k], starts[k] = len(own), len(ids)
            ids = np.concatenate([ids, own])
        stops = np.cumsum(per_word)
        return ids[np.repeat(starts - (stops - per_word), per_word) + np.arange(stops[-1])], per_word


def slots(tokens: int, capacity: int) -> list[int]:
    """Sizes of sequences for so many tokens: full ones, then the rest as powers of two."""
    rest = tokens % capacity
    return [capacity] * (tokens // capacity) + [1 << i for i in reversed(range(rest.bit_length())) if rest >> i & 1]


def place(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of pieces that fill the slots of all documents exactly."""
    out, rest = [], []
    n_full = 0
    for d, n in enumerate(lengths):
        for start in range(0, int(n) - capacity + 1, capacity):
            out.append((d, start, capacity, n_full, 0))
            n_full += 1
        if n % capacity:
            rest.append((int(n % capacity), d, int(n - n % capacity)))
    room = np.array(slots(sum(r[0] for r in rest), capacity), np.int64)
    used, cost = np.zeros_like(room), np.zeros(len(room))
    rest.sort(key=lambda r: (-r[0], r[1]))
    for n, d, start in rest:
        while n:
            free = room - used
            fits = free >= n
            best = int(np.where(fits if fits.any() else free > 0, cost, np.inf).argmin())
            k = min(n, int(free[best]))
            out.append((d, start, k, n_full + best, int(used[best])))
            used[best] += k
            cost[best] += linear * k + quadratic * k * k
            n, start = n - k, start + k
    return out


_tokenizers: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker, which serves many tasks."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 1,
    capacity: int = 2048,
    pool_tokens: int = 1 << 20,
    linear: float = 1.0,
    quadratic: float = 1.0 / 1024,
    pool_chars: int = 4_000_000,
) -> DataFrame:
    """(doc_id, text) -> the pieces of the documents by sequence, their ids as little-endian unsigned 32-bit numbers."""

    def pooled(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
        ids, texts, chars = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                ids.append(doc_id)
                texts.append(text)
                chars += len(text) + 1
                if chars >= pool_chars:
                    yield ids, texts
                    ids, texts, chars = [], [], 0
        if ids:
            yield ids, texts

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_path)
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 32
        waiting: list[tuple[list, np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            doc_ids = [i for w in waiting for i in w[0]]
            lengths = np.concatenate([w[1] for w in waiting])
            tokens = np.concatenate([w[2] for w in waiting])
            waiting.clear()
            begins = np.cumsum(lengths) - lengths
            placed = np.array(place(lengths, capacity, linear, quadratic), np.int64).reshape(-1, 5)
            d, start, length, seq, offset = placed.T
            for a in range(0, len(d), 1024):
                part = slice(a, a + 1024)
                raw = [tokens[begins[i] + s : begins[i] + s + n].astype("<u4").tobytes() for i, s, n in zip(d[part], start[part], length[part])]
                yield pa.record_batch(
                    [pa.array([doc_ids[i] for i in d[part]], pa.int64()), pa.array(start[part]), pa.array(length[part]), pa.array(raw, pa.binary()), pa.array(lengths[d[part]]), pa.array(seq[part] + sequence), pa.array(offset[part])],
                    schema=ARROW_SCHEMA,
                )
            sequence += int(seq.max()) + 1
            del tokens
            release_memory()

        held = 0
        for ids, texts in pooled(batches):
            tokens, counts = tokenizer.encode(texts)
            stops = np.cumsum(counts + 1)
            with_end = np.full(int(stops[-1]), end_id, np.uint32)
            own = np.ones(len(with_end), bool)
            own[stops - 1] = False
            with_end[own] = tokens
            waiting.append((ids, counts + 1, with_end))
            held += len(with_end)
            if held >= pool_tokens:
                yield from flush()
                held = 0
        if waiting:
            yield from flush()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
