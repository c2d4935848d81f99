"""BPE encoding and decoding by batched numpy merge rounds.

A text is cut at ASCII white space into chunks, and a chunk into words. Chunks and words seen before are looked up; the new
words of a batch are encoded together: their symbols lie in one flat array, neighbouring pairs are found by binary
search among the sorted keys of the merges, each word's lowest-ranked pair is merged, and words without a pair leave the
array; after a round only the pairs beside a merge are searched again. A word's rounds follow the order of the library's
own queue: lowest rank first, then leftmost. All places of a pair in a word are merged in one round where no merge of
the new symbol can rank lower, which holds for ordinary vocabularies and is checked for each merge; otherwise only
the leftmost is.

A long word is encoded in parts of PART bytes, whose ids are then joined in pairs. A list of tokens is a word's encoding if
and only if each two neighbours are the encoding of their own bytes: no merge crosses their border in the whole word unless
one does in the two. So a joint is right once the tokens around it, encoded anew, begin and end with the tokens they began
and ended with; until then it takes in twice as many.

ASCII chunks are cut by the vocabulary's pattern. Others are normalised and cut by the library's own normaliser and
pattern, whose Unicode tables differ from Python's.

Defined results: a null or blank text has no ids, and decodes to an empty text. The strings of special tokens inside a
text become those tokens, as the library does. Words of any length are encoded whole.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tesserae.llm.common import ROWS, map_texts, text_of

#: Bytes of text, and of words, that are encoded together.
BLOCK = 1 << 21
#: Bytes of chunks or words and their ids that a task remembers; beyond it the memory starts anew. Results don't depend on it.
REMEMBERED = 48 << 20
#: Longer words are encoded in parts of PART bytes; longer chunks are not remembered.
LONG, PART = 96, 32
NONE = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: itself if printable, else the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Vocabulary:
    """A byte-level BPE vocabulary with word ends, from a tokenizer file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        suffix = model["end_of_word_suffix"] or ""
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        library = Tokenizer.from_file(path)
        self.normaliser, self.cutter = library.normalizer, library.pre_tokenizer[0]
        named = self.ids | {t.decode(): i for t, i in self.special.items()}
        self.tokens = {i: t.encode() for t, i in named.items()}
        self.size = max(self.tokens) + 1
        self.bytes_of = np.zeros(self.size, np.int64)
        for t, i in self.ids.items():
            self.bytes_of[i] = len(t.removesuffix(suffix)) if suffix else len(t)
        letters = byte_letters()
        self.inner = np.array([self.ids[c] for c in letters], np.int64)
        self.last = np.array([self.ids[c + suffix] for c in letters], np.int64)
        pairs = [(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        a, b, made = np.array(pairs, np.int64).T
        rank = np.arange(len(a))
        order = np.argsort(a * self.size + b, kind="stable")
        self.keys, self.ranks, self.made = (a * self.size + b)[order], rank[order], made
        first_use = np.full(self.size, NONE)
        np.minimum.at(first_use, a, rank)
        np.minimum.at(first_use, b, rank)
        self.all_at_once = first_use[made] > rank

    def words_of(self, chunk: str) -> list[str]:
        """Words of a text without ASCII white space and special tokens."""
        if chunk.isascii():
            return self.pattern.findall(chunk.lower())
        return [w for w, _ in self.cutter.pre_tokenize_str(self.normaliser.normalize_str(chunk))]

    def _rank(self, symbol: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ranks of the pairs that begin at the places at, NONE where there is no merge."""
        after = np.minimum(at + 1, len(symbol) - 1)
        pair = symbol[at] * self.size + symbol[after]
        k = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where((self.keys[k] == pair) & (word[at] == word[after]) & (after > at), self.ranks[k], NONE)

    def rounds(self, words: list[bytes], ended: np.ndarray | None = None) -> list[np.ndarray]:
        """Ids of each word (not empty), by merge rounds over all of them; ended: where the last byte ends a word, else everywhere."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        word = np.repeat(np.arange(len(words)), sizes)
        symbol, ends = self.inner[raw], np.cumsum(sizes) - 1
        ends = ends if ended is None else ends[ended]
        symbol[ends] = self.last[raw[ends]]
        rank = self._rank(symbol, word, np.arange(len(symbol)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            low = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(word))))
            over = low == NONE
            if over.any():
                done.append((word[over], symbol[over]))
                symbol, word, rank, low = symbol[~over], word[~over], rank[~over], low[~over]
            q = np.flatnonzero(rank == low)
            if not len(q):
                break
            new = np.append(True, q[1:] != q[:-1] + 1)
            keep = (np.arange(len(q)) - np.maximum.accumulate(np.where(new, np.arange(len(q)), 0))) % 2 == 0
            leftmost = np.append(True, word[q[1:]] != word[q[:-1]])
            q = q[np.where(self.all_at_once[rank[q]], keep, leftmost)]
            symbol[q] = self.made[rank[q]]
            stay = np.ones(len(symbol), bool)
            stay[q + 1] = False
            symbol, word, rank = symbol[stay], word[stay], rank[stay]
            at = q - np.arange(len(q))
            changed = np.concatenate([at, at[at > 0] - 1])
            rank[changed] = self._rank(symbol, word, changed)
        of, ids = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(of, kind="stable")
        return np.split(ids[order], np.cumsum(np.bincount(of, minlength=len(words)))[:-1])

    def _blocks(self, words: list[bytes], ended: np.ndarray | None = None) -> list[np.ndarray]:
        """rounds, over words of at most BLOCK bytes and one word more at once."""
        out, start, size = [], 0, 0
        for k, w in enumerate(words, 1):
            size += len(w)
            if size >= BLOCK or k == len(words):
                out += self.rounds(words[start:k], None if ended is None else ended[start:k])
                start, size = k, 0
        return out

    def _joined(self, joints: list[tuple[bytes, int, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """Ids of the neighbours in each joint (word, place of the border, ids before it, ids behind it), as one list."""
        out: list = [None] * len(joints)
        waiting, reach = list(range(len(joints))), 4
        while waiting:
            windows, ended = [], []
            for k in waiting:
                word, at, a, b = joints[k]
                end = at + int(self.bytes_of[b[:reach]].sum())
                windows.append(word[at - int(self.bytes_of[a[-reach:]].sum()) : end])
                ended.append(end == len(word))
            still = []
            for k, w in zip(waiting, self._blocks(windows, np.array(ended))):
                _, _, a, b = joints[k]
                if (len(a) <= reach or w[0] == a[-reach]) and (len(b) <= reach or w[-1] == b[reach - 1]):
                    out[k] = np.concatenate([a[:-reach], w, b[reach:]])
                else:
                    still.append(k)
            waiting, reach = still, 2 * reach
        return out

    def _in_parts(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of long words."""
        cuts = [range(0, len(w), PART) for w in words]
        pieces = [w[k : k + PART] for w, c in zip(words, cuts) for k in c]
        ended = np.zeros(len(pieces), bool)
        ended[np.cumsum([len(c) for c in cuts]) - 1] = True
        found = iter(self._blocks(pieces, ended))
        parts = [[(k, next(found)) for k in c] for c in cuts]
        while any(len(p) > 1 for p in parts):
            joints = [(w, p[k + 1][0], p[k][1], p[k + 1][1]) for w, p in zip(words, parts) for k in range(0, len(p) - 1, 2)]
            found = iter(self._joined(joints))
            parts = [[(p[k][0], next(found)) if k + 1 < len(p) else p[k] for k in range(0, len(p), 2)] for p in parts]
        return [p[0][1] for p in parts]

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word (not empty), as little-endian unsigned 32-bit integers."""
        out: list = [None] * len(words)
        is_long = [len(w) > LONG for w in words]
        for long, encode in ((False, self._blocks), (True, self._in_parts)):
            at = [k for k, x in enumerate(is_long) if x == long]
            for k, ids in zip(at, encode([words[k] for k in at]) if at else ()):
                out[k] = ids.astype("<u4").tobytes()
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens joined by spaces (the file names no decoder), in UTF-8."""
        return b" ".join(map(self.tokens.__getitem__, ids.tolist()))


class Memory:
    """What was encoded before, known: bytes -> ids; at most REMEMBERED bytes of them, and none of over LONG bytes."""

    def __init__(self) -> None:
        self.known: dict[bytes, bytes] = {}
        self.size = 0

    def learn(self, pairs: Iterable[tuple[bytes, bytes]]) -> dict[bytes, bytes]:
        """Adds pairs, and gives back those that are too long to be remembered."""
        rare = {}
        for key, ids in pairs:
            if len(key) <= LONG:
                self.known[key] = ids
                self.size += len(key) + len(ids)
            else:
                rare[key] = ids
        return rare

    def forget(self, most: int | None = None) -> None:
        """Starts anew beyond most bytes, REMEMBERED if not given."""
        if self.size > (REMEMBERED if most is None else most):
            self.known.clear()
            self.size = 0


class Encoder:
    """Encodes texts chunk by chunk and remembers the ids of chunks; new: from distinct new chunks to their ids."""

    def __init__(self, new: Callable[[list[bytes]], list[bytes]]) -> None:
        self.new, self.memory = new, Memory()

    def _block(self, texts: list[bytes]) -> Iterator[bytes]:
        self.memory.forget()
        known, cut, missing = self.memory.known, [t.split() for t in texts], set()
        for chunks in cut:
            missing.update(set(chunks).difference(known))
        fresh = list(missing)
        rare = self.memory.learn(zip(fresh, self.new(fresh))) if fresh else {}
        for chunks in cut:
            if rare and not rare.keys().isdisjoint(chunks):
                yield b"".join([known[c] if c in known else rare[c] for c in chunks])
            else:
                yield b"".join(map(known.__getitem__, chunks))

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers; texts of BLOCK bytes at a time."""
        block, size = [], 0
        for t in texts:
            block.append(t.encode())
            size += len(block[-1])
            if size >= BLOCK:
                yield from self._block(block)
                block, size = [], 0
        if block:
            yield from self._block(block)


class ChunkEncoder:
    """From distinct chunks to their ids, by merge rounds over their new words."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v, self.memory = vocabulary, Memory()
        self.marks = regex.compile(b"(" + b"|".join(map(regex.escape, vocabulary.special)) + b")") if vocabulary.special else None

    def _cut(self, chunk: bytes) -> list[bytes | int]:
        """Words of a chunk, and the ids of special tokens between them."""
        if chunk.isalpha():  # of bytes: A-Z and a-z only
            return [chunk.lower()]
        pieces = self.marks.split(chunk) if self.marks else [chunk]
        if len(pieces) == 1:
            return [w.encode() for w in self.v.words_of(chunk.decode())]
        return [x for p in pieces for x in ([self.v.special[p]] if p in self.v.special else map(str.encode, self.v.words_of(p.decode())))]

    def forget(self) -> None:
        self.memory.forget(0)

    def __call__(self, chunks: list[bytes]) -> list[bytes]:
        self.memory.forget()
        known, cut = self.memory.known, list(map(self._cut, chunks))
        fresh = list({w for words in cut for w in words}.difference(known, self.v.special.values()))
        rare = self.memory.learn(zip(fresh, self.v.merge(fresh)))
        rare.update((i, np.array([i], "<u4").tobytes()) for i in self.v.special.values())
        return [b"".join([known[w] if w in known else rare[w] for w in words]) for words in cut]


def forget(path: str) -> None:
    """Gives back what this process's encoder remembers: a Python worker lives on after its task, beside those of other stages."""
    _, e = encoder(path)
    e.memory.forget(0)
    e.new.forget()


@functools.cache
def encoder(path: str) -> tuple[Vocabulary, Encoder]:
    """This process's vocabulary and encoder for a tokenizer file."""
    v = Vocabulary(path)
    return v, Encoder(ChunkEncoder(v))


def ids_array(encoded: list[bytes]) -> pa.Array:
    """Encoded texts as lists of integers."""
    offsets = np.cumsum([0, *(len(x) // 4 for x in encoded)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(encoded), "<i4")))


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row, a BLOCK of bytes at a time."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, e = encoder(path)
        try:
            for b in batches:
                for k in range(0, b.num_rows, ROWS):
                    part = b.slice(k, ROWS)
                    yield pa.RecordBatch.from_arrays([part.column(0), ids_array(list(e.encode(part.column(1).to_pylist())))], ["doc_id", "ids"])
        finally:
            forget(path)

    return docs.select("doc_id", text_of(docs, text).alias("_text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, _ = encoder(path)
        for b in batches:
            texts = [v.decode(np.asarray(ids.values if ids.is_valid else [], np.int64)).decode() for ids in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Encodes every text and decodes its ids again: doc_id, n_tokens, and SHA-256 of the ids and of the decoded text."""

    def start() -> Callable[[list[str]], list]:
        v, e = encoder(path)

        def columns_of(texts: list[str]) -> list[list]:
            encoded = list(e.encode(texts))
            back = (v.decode(np.frombuffer(x, "<u4")) for x in encoded)
            return [[len(x) // 4 for x in encoded], [hashlib.sha256(x).hexdigest() for x in encoded], [hashlib.sha256(t).hexdigest() for t in back]]

        return columns_of

    return map_texts(docs, text, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}, start, lambda: forget(path))
