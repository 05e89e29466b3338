"""BPE encoding and decoding by per-prefix dynamic programming, with a byte-level vocabulary of the `tokenizers` library.

Texts are cut into words as the vocabulary's pre-tokenizer cuts them, in numpy over the code points of many texts; each
character's class is asked of the pre-tokenizer itself, once. Every distinct word is then encoded once a worker:

1. An automaton over the bytes of all tokens reads the word. Its state after each prefix gives the tokens that end the
   prefix, longest first, by suffix links.
2. Exactly one of them is the last token of the prefix's encoding: the one that is compatible with the last token of
   what stands before it. Two tokens are compatible if merges alone would leave them side by side: their merges are
   undone from the latest to the earliest, and at no time may the two parts that touch be due to merge before the next
   merge of either. The token is stored for the prefix.
3. The stored tokens are followed back from the end of the word to its start.

Words of a batch advance together, one byte a step, so that a step is a few numpy calls over all of them. Known words
are found by a 64-bit hash. Every text is decoded from its ids; where the bytes differ from the text's, which only two
words of one hash can cause, the text is encoded again without known words. So the ids are exact.

Memory: the automaton (about 20 MB), most_words known words, and `CHARS` characters at a time, or one text if it is
longer.

Defined cases: a null or empty text has no tokens; special tokens in a text are their own ids unless special=False;
any length of text or word is encoded whole; repeated rows and ids, and rows without an id, are rows of their own; an
empty table gives an empty table; columns of the input named like those added are replaced.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from confluo.llm.common import without

CHARS = 2_000_000
LONGEST_KNOWN = 64
_SPACE, _LETTER, _DIGIT, _OTHER, _GAP, _UNKNOWN = range(6)
_NONE = np.iinfo(np.int64).max


def flat_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start ... start + length - 1 of every range, one after the other."""
    stops = np.cumsum(lengths)
    total = int(stops[-1]) if len(stops) else 0
    return np.repeat(starts - (stops - lengths), lengths) + np.arange(total)


class Words:
    """Ids of words that stand in a byte buffer: known ones by their hash, others from `encode`, which takes
    (buffer, starts, lengths) and returns (ids, number of ids of each word)."""

    def __init__(self, encode: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], most_words: int = 1_000_000):
        self.encode, self.most_words = encode, most_words
        self.forget()

    def forget(self) -> None:
        self.slots = np.full(1 << (4 * self.most_words - 1).bit_length(), -1, np.int32)  # open addressing; the word's number
        self.keys = np.zeros(0, np.uint64)
        self.starts = self.lengths = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each known word, else -1."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return out
        live, slot = np.arange(len(keys)), (keys & np.uint64(len(self.slots) - 1)).astype(np.int64)
        while len(live):
            number = self.slots[slot]
            same = self.keys[number] == keys[live]
            hit = same & (number >= 0)
            out[live[hit]] = number[hit]
            rest = ~same & (number >= 0)
            live, slot = live[rest], (slot[rest] + 1) & (len(self.slots) - 1)
        return out

    def _add(self, keys: np.ndarray, begins: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        number = len(self.keys) + np.arange(len(keys))
        self.keys, self.starts, self.lengths, self.ids = (np.concatenate(x) for x in ((self.keys, keys), (self.starts, begins), (self.lengths, counts), (self.ids, ids.astype(np.int32))))
        slot = (keys & np.uint64(len(self.slots) - 1)).astype(np.int64)
        while len(number):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = number[free]
            rest = self.slots[slot] != number  # taken, or another of these words was faster
            number, slot = number[rest], (slot[rest] + 1) & (len(self.slots) - 1)

    @staticmethod
    def _hashes(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each word, eight bytes a step."""
        out = lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        padded = np.concatenate([buffer, np.zeros(8, np.uint8)])
        eights = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(buffer) + 1,), (1,))
        live = np.arange(len(starts))
        at, left = starts, lengths
        with np.errstate(over="ignore"):
            while len(live):
                chunk = eights[at] & (~np.uint64(0) >> (np.uint64(8) * (8 - np.minimum(left, 8)).astype(np.uint64)))
                value = (out[live] ^ chunk) * np.uint64(0xFF51AFD7ED558CCD)
                value ^= value >> np.uint64(32)
                out[live] = value * np.uint64(0xC4CEB9FE1A85EC53)
                more = left > 8
                live, at, left = live[more], at[more] + 8, left[more] - 8
        return out ^ (out >> np.uint64(29))

    def look_up(self, buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, number of ids of each)."""
        if not len(starts):
            return self.ids[:0], lengths
        short = lengths <= LONGEST_KNOWN
        keys = self._hashes(buffer, starts, np.minimum(lengths, LONGEST_KNOWN))
        at = self._find(keys)
        missing = np.flatnonzero(short & (at < 0))
        if len(missing):
            fresh, one = np.unique(keys[missing], return_index=True)
            one = missing[one]
            if len(self.keys) + len(fresh) > self.most_words:
                self.forget()
                fresh, one = np.unique(keys[short], return_index=True)
                one = np.flatnonzero(short)[one]
                if len(fresh) > self.most_words:  # one enormous text
                    return self.encode(buffer, starts, lengths)
            ids, counts = self.encode(buffer, starts[one], lengths[one])
            self._add(fresh, len(self.ids) + np.cumsum(counts) - counts, counts, ids)
            at = self._find(keys)
        at[~short] = 0
        pool = self.ids
        first, counts = (self.starts[at], self.lengths[at]) if len(self.keys) else (np.zeros_like(lengths), np.zeros_like(lengths))
        long = np.flatnonzero(~short)
        if len(long):
            ids, n = self.encode(buffer, starts[long], lengths[long])
            first[long], counts[long] = len(pool) + np.cumsum(n) - n, n
            pool = np.concatenate([pool, ids.astype(np.int32)])
        return pool[flat_ranges(first, counts)], counts


class ByteBPE:
    """A byte-level BPE vocabulary: encode and decode."""

    def __init__(self, path: str, most_words: int = 1_000_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.cut = Tokenizer.from_file(path).pre_tokenizer
        # a byte's character: itself if visible in Latin-1, else the next one from 256 on
        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in visible]
        byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        n = max([*vocab.values(), *self.special.values()]) + 1
        spelled = [b""] * n
        for token, i in vocab.items():
            spelled[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            spelled[i] = token.encode()
        self.size = n
        self.lengths = np.array([len(x) for x in spelled], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)
        self._read_merges(vocab, [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in spec["model"]["merges"]])
        self._build_automaton(np.array(sorted(vocab.values()), np.int64))
        self.classes = np.full(0x110000, _UNKNOWN, np.uint8)
        self.words = Words(self.encode_words, most_words)
        self.tested = np.full(1 << 20, -1, np.int64)  # pairs of tokens whose compatibility is known
        self.compatible_bits = np.zeros(1 << 20, bool)

    # --- the vocabulary ------------------------------------------------------------------------------------------------

    def _read_merges(self, vocab: dict[str, int], merges: list[tuple[str, str]]) -> None:
        self.rank = np.full(self.size, -1, np.int64)
        self.left, self.right = np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        keys = np.zeros(len(merges), np.int64)
        for r, (a, b) in enumerate(merges):
            made = vocab[a + b]
            if self.rank[made] >= 0:
                raise ValueError(f"two merges make token {made}")
            self.rank[made], self.left[made], self.right[made] = r, vocab[a], vocab[b]
            keys[r] = vocab[a] * self.size + vocab[b]
        self.pair_rank = np.argsort(keys)
        self.pair_keys = keys[self.pair_rank]

    def _build_automaton(self, tokens: np.ndarray) -> None:
        """Nodes of the tokens' trie by depth; edges as sorted (node, byte); suffix links level by level."""
        node = np.zeros(len(tokens), np.int64)
        edges, children, levels = [], [], []
        n, depth = 1, 0
        live = np.arange(len(tokens))
        token_of = {0: -1}
        while True:
            live = live[self.lengths[tokens[live]] > depth]
            if not len(live):
                break
            keys = node[live] << 8 | self.bytes[self.begins[tokens[live]] + depth]
            distinct, where = np.unique(keys, return_inverse=True)
            node[live] = n + where
            edges.append(distinct)
            children.append(n + np.arange(len(distinct)))
            n, depth = n + len(distinct), depth + 1
            levels.append((distinct, children[-1]))
        edges, children = np.concatenate(edges), np.concatenate(children)
        order = np.argsort(edges)
        self.edges, self.children = edges[order], children[order]
        self.depth = np.zeros(n, np.int64)
        self.token = np.full(n, -1, np.int64)
        self.token[node] = tokens
        self.link = np.zeros(n, np.int64)
        for d, (keys, nodes) in enumerate(levels):
            self.depth[nodes] = d + 1
            if d:
                self.link[nodes] = self.step(self.link[keys >> 8], keys & 255)
        # the longest token that ends here, and the next shorter one
        self.ends, self.shorter = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for _, nodes in levels:
            self.shorter[nodes] = self.ends[self.link[nodes]]
            self.ends[nodes] = np.where(self.token[nodes] >= 0, nodes, self.shorter[nodes])
        if (self.ends[self.children[: np.searchsorted(self.edges, 256)]] == 0).any() or np.searchsorted(self.edges, 256) < 256:
            raise ValueError("every byte must be a token")

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The automaton's next states."""
        out = np.zeros(len(state), np.int64)
        live = np.arange(len(state))
        while len(live):
            keys = state << 8 | byte
            at = np.minimum(np.searchsorted(self.edges, keys), len(self.edges) - 1)
            hit = self.edges[at] == keys
            out[live[hit]] = self.children[at[hit]]
            rest = ~hit & (state > 0)
            live, state, byte = live[rest], self.link[state[rest]], byte[rest]
        return out

    # --- words ---------------------------------------------------------------------------------------------------------

    def _merge_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_rank[at], _NONE)

    def _undo(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merges alone leave the tokens a and b side by side."""
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        due = np.full(len(a), _NONE)  # the parts that touch must not merge before this rank
        while len(live):
            early = self._merge_ranks(a, b) < due
            good[live[early]] = False
            rank_a, rank_b = self.rank[a], self.rank[b]
            left = rank_a > rank_b  # of two merges of one rank the left one came first
            go = ~early & ((rank_a >= 0) | (rank_b >= 0))
            # a meeting pair lies to the right of a's merge and to the left of b's: at b's own rank it goes first
            due = np.where(left, rank_a, rank_b + 1)[go]
            a, b, live = np.where(left, self.right[a], a)[go], np.where(left, b, self.left[b])[go], live[go]
        return good

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a * self.size + b
        slot = (keys * 0x9E3779B1 >> 7) & (len(self.tested) - 1)
        new = np.flatnonzero(self.tested[slot] != keys)
        out = self.compatible_bits[slot]
        if len(new):
            out[new] = self._undo(a[new], b[new])
            self.tested[slot[new]] = keys[new]
            kept = new[self.tested[slot[new]] == keys[new]]  # of pairs that share a slot one stays
            self.compatible_bits[slot[kept]] = out[kept]
        return out

    def encode_words(self, buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words one after the other, number of ids of each): no merge crosses a word's end."""
        order = np.argsort(-lengths, kind="stable")
        ids, counts = [], np.zeros(len(starts), np.int64)
        begin = 0
        while begin < len(order):  # words of similar length share a table of bounded size
            longest = max(1, int(lengths[order[begin]]))
            group = order[begin : begin + max(1, 4_000_000 // longest)]
            begin += len(group)
            found, n = self._encode_group(buffer, starts[group], lengths[group])
            counts[group] = n
            ids.append(found)
        found = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        n = counts[order]
        first = np.zeros(len(starts), np.int64)
        first[order] = np.cumsum(n) - n
        return found[flat_ranges(first, counts)], counts

    def _encode_group(self, buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As encode_words, for words in descending order of length."""
        longest = int(lengths[0])
        last = np.zeros((longest + 1, len(starts)), np.int32)
        state = np.zeros(len(starts), np.int64)
        many = np.searchsorted(-lengths, -np.arange(1, longest + 1), side="right")
        for i in range(1, longest + 1):
            n = int(many[i - 1])
            state = self.step(state[:n], buffer[starts[:n] + (i - 1)].astype(np.int64))
            lane, end = np.arange(n), self.ends[state]
            while len(lane):
                token, before = self.token[end], i - self.depth[end]
                good = before == 0
                rest = np.flatnonzero(~good)
                good[rest] = self.compatible(last[before[rest], lane[rest]].astype(np.int64), token[rest])
                last[i, lane[good]] = token[good]
                lane, end = lane[~good], self.shorter[end[~good]]
        # back from the end
        tokens, lanes = [], []
        lane, at = np.arange(len(starts)), lengths
        while len(lane):
            more = at > 0
            lane, at = lane[more], at[more]
            token = last[at, lane]
            tokens.append(token)
            lanes.append(lane)
            at = at - self.lengths[token]
        tokens, lanes = np.concatenate(tokens[::-1]), np.concatenate(lanes[::-1])
        return tokens[np.argsort(lanes, kind="stable")], np.bincount(lanes, minlength=len(starts))

    # --- texts ---------------------------------------------------------------------------------------------------------

    def _classify(self, points: np.ndarray) -> np.ndarray:
        """The pre-tokenizer's class of each code point; it keeps two of one class together."""
        found = self.classes[points]
        unknown = np.unique(points[found == _UNKNOWN])
        if len(unknown):
            for c in unknown.tolist():
                one = lambda before: len(self.cut.pre_tokenize_str(before + chr(c))) == 1  # noqa: B023,E731
                self.classes[c] = _LETTER if one("a") else _DIGIT if one("1") else _SPACE if one("\t") else _OTHER
            found = self.classes[points]
        return found

    def _word_starts(self, points: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Whether a word starts, for each code point; gaps are words of their own."""
        n = len(points)
        starts = np.ones(n + 3, bool)
        starts[1:n] = (classes[1:] != classes[:-1]) | (classes[1:] == _GAP)
        space = classes == _SPACE
        ends = np.flatnonzero(space[:-1] & ~space[1:] & (classes[1:] != _GAP))  # last of white space before a word
        starts[ends] = True
        starts[ends[points[ends] == 32] + 1] = False  # a space belongs to the word after it
        quotes = np.flatnonzero((points[1:-1] == 39) & (classes[:-2] != _OTHER) & (points[:-2] != 32) & (classes[2:] == _LETTER)) + 1
        if len(quotes):  # 's 't 'm 'd 're 've 'll are words
            padded = np.concatenate([points, np.zeros(2, points.dtype)])
            one, two = padded[quotes + 1], padded[quotes + 2]
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = (two == ord("e")) & np.isin(one, [ord("r"), ord("v")]) | (one == ord("l")) & (two == ord("l"))
            starts[quotes[short | long] + 1] = False
            for after in (quotes[short] + 2, quotes[long] + 3):
                starts[after[np.append(classes, [_GAP] * 3)[after] == _LETTER]] = True
        return starts[:n]

    def encode(self, texts: list[str], special: bool = True, known: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text)."""
        pieces, owner, marks = [], [], []  # pieces between special tokens; marks: the id that stands before a piece
        for i, text in enumerate(texts):
            rest = [(text, -1)]
            for content, mark in self.special.items() if special else ():
                if content in text:
                    rest = [(p, mark if k else m) for t, m in rest for k, p in enumerate(t.split(content))]
            for piece, mark in rest:
                pieces.append(piece)
                owner.append(i)
                marks.append(mark)
        if not pieces:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # a gap, which is one byte long, before each piece and at the end
        points = np.frombuffer("".join(["\0" + p for p in pieces] + ["\0"]).encode("utf-32-le"), np.uint32)
        sizes = np.array([len(p) + 1 for p in pieces])
        gaps = np.append(np.cumsum(sizes) - sizes, len(points) - 1)
        classes = self._classify(points).copy()
        classes[gaps] = _GAP
        starts = np.flatnonzero(self._word_starts(points, classes))
        widths = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
        at = np.concatenate([[0], np.cumsum(widths, dtype=np.int64)])
        buffer = np.frombuffer("".join(["\0" + p for p in pieces] + ["\0"]).encode(), np.uint8)
        begins = at[starts]
        lengths = np.append(begins[1:], len(buffer)) - begins
        gap = classes[starts] == _GAP
        look_up = self.words.look_up if known else self.encode_words
        ids, counts = look_up(buffer, begins[~gap], lengths[~gap])
        # ids of gaps: the mark of a piece, if it has one
        marks = np.array([*marks, -1], np.int64)
        per_word = np.zeros(len(starts), np.int64)
        per_word[~gap] = counts
        per_word[gap] = marks >= 0
        stops = np.cumsum(per_word)
        out = np.empty(int(stops[-1]), np.int64)
        own = np.ones(len(out), bool)
        marked = stops[gap][marks >= 0] - 1
        own[marked] = False
        out[own], out[marked] = ids, marks[marks >= 0]
        before = (stops - per_word)[gap]
        return out, np.bincount(np.array(owner), weights=np.diff(before), minlength=len(texts)).astype(np.int64)

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[flat_ranges(self.begins[ids], self.lengths[ids])]

    def encode_checked(self, texts: list[str], special: bool = True) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """(ids, number of ids of each text, the bytes decoded from each): exact, whatever the hashes of words."""
        ids, counts = self.encode(texts, special)
        ends = np.cumsum(counts)
        decoded = self.decode_bytes(ids).tobytes()
        stops = np.concatenate([[0], np.cumsum(self.lengths[ids])])[ends]
        parts = [decoded[a:b] for a, b in zip(np.concatenate([[0], stops[:-1]]).tolist(), stops.tolist())]
        wrong = [i for i, (t, p) in enumerate(zip(texts, parts)) if t.encode() != p]
        if wrong:
            split = np.split(ids, ends[:-1])
            for i in wrong:
                split[i] = self.encode([texts[i]], special, known=False)[0]
                counts[i], parts[i] = len(split[i]), self.decode_bytes(split[i]).tobytes()
            ids = np.concatenate(split)
        return ids, counts, parts


_vocabularies: dict[str, ByteBPE] = {}


def vocabulary(path: str) -> ByteBPE:
    """One for each Python worker, which serves many tasks."""
    if path not in _vocabularies:
        _vocabularies[path] = ByteBPE(path)
    return _vocabularies[path]


def pooled(batch: pa.RecordBatch, column: int, most: int = CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of consecutive rows with about so many characters."""
    texts, first, held = [], 0, 0
    for i, text in enumerate(batch.column(column)):
        text = text.as_py() or ""
        texts.append(text)
        held += len(text) + 1
        if held >= most:
            yield first, texts
            texts, first, held = [], i + 1, 0
    if texts:
        yield first, texts


def encode(docs: DataFrame, path: str, text: str = "text", special: bool = True, ids: bool = True, decoded: bool = True) -> DataFrame:
    """The input's columns but its text, with n_tokens, and as asked ids (little-endian unsigned 32-bit numbers, as
    bytes) and decoded (the text that the ids give)."""
    added = [T.StructField("n_tokens", T.LongType()), *([T.StructField("ids", T.BinaryType())] if ids else []), *([T.StructField("decoded", T.StringType())] if decoded else [])]
    kept = without(docs, *[f.name for f in added])
    rest = [c for c in kept.columns if c != text]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            for first, texts in pooled(batch, batch.num_columns - 1):
                found, counts, parts = vocab.encode_checked(texts, special)
                columns = [c.slice(first, len(texts)) for c in batch.columns[:-1]] + [pa.array(counts)]
                if ids:
                    raw, stops = found.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
                    columns.append(pa.array([raw[a:b] for a, b in zip([0, *stops], stops)], pa.binary()))
                if decoded:
                    columns.append(pa.array([p.decode("utf-8", "replace") for p in parts], pa.string()))
                yield pa.record_batch(columns, names=[*batch.schema.names[:-1], *[f.name for f in added]])

    schema = T.StructType([*[kept.schema[c] for c in rest], *added])
    return kept.select(*[F.col(f"`{c}`") for c in [*rest, text]]).mapInArrow(run, schema)
