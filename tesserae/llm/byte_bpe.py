"""Byte-level BPE by Spark's higher-order functions, with ranks as in tiktoken's files.

A text is cut by the vocabulary's pattern. A word is its bytes' tokens, and merges are folded over it: each step joins the
neighbours of the lowest rank, leftmost first, and looks up only the two pairs beside the new token. Tokens are written as letters
(letter_of), so that a word is a string, a step replaces two letters by one, and the lowest rank is the least letter. Of the ways to cut
a token in two, only the one that its own bytes' merges come to can stand side by side; so there is one merge a token.

The map of merges is a literal: an array of small maps, indexed by a hash of the key, since Spark searches a map from its start. The
fold makes the encodings of the WORDS most frequent distinct words in a sample of the texts (SAMPLE, by hash), and these are a second literal
of this form, in which all words of all texts are looked up. Rare words, a tenth of all, are merged in Arrow batches by a list or,
from LONG bytes on, a queue of pairs (encode_word): a fold takes some 100 microseconds for each, eight times as long. Results do
not depend on the sample; nothing is shuffled but the sample's counts, and what a task holds has a bound.

Ids are decoded by a literal array of the tokens' bytes in hexadecimal, which are joined and read as binary.

Defined results: a null text is empty and has no ids; equal texts have equal ids; ids that are null or unknown decode to nothing. Other
columns are not read.
"""

from __future__ import annotations

import base64
import functools
import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import ROWS, hashed_sample, let, text_of

#: Words whose encodings are kept as a literal, of WORD_BYTES bytes at most, and the texts in which they are counted.
WORDS, WORD_BYTES, SAMPLE = 1 << 16, 64, 10_000
#: Bytes from which a word is merged by a queue; rare words that a task remembers.
LONG, REMEMBERED = 96, 400_000
NO_RANK = 1 << 60
BUCKETS = 1 << 15
#: The first token's letter; the mark at a word's ends; what stands for no merge, above all letters.
FIRST, MARK, NONE = 0x100, chr(1), chr(0x10FFFF)

# Letters and numbers of Unicode 14 to 16 that Java 17 does not know, and Unicode's white space.
NEW_LETTERS = (
    "870-887 889-88E 8B5 8C8-8C9 C5D CDD 170D 171F 1B4C 1C89-1C8A 2C2F 2C5F 9FFD-9FFF A7C0-A7C1 A7CB-A7CD A7D0-A7D1 A7D3 A7D5-A7DC A7F2-A7F4 10570-1057A 1057C-1058A 1058C-10592 "
    "10594-10595 10597-105A1 105A3-105B1 105B3-105B9 105BB-105BC 105C0-105F3 10780-10785 10787-107B0 107B2-107BA 10D4A-10D65 10D6F-10D85 10EC2-10EC4 10F70-10F81 11071-11072 11075 1123F-11240 "
    "11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 11740-11746 11AB0-11ABF 11BC0-11BE0 11F02 11F04-11F10 11F12-11F33 12F90-12FF0 1342F 13441-13446 13460-143FA 16100-1611D "
    "16A70-16ABE 16D40-16D6C 18CFF 1AFF0-1AFF3 1AFF5-1AFFB 1AFFD-1AFFE 1B11F-1B122 1B132 1B155 1DF00-1DF1E 1DF25-1DF2A 1E030-1E06D 1E290-1E2AD 1E4D0-1E4EB 1E5D0-1E5ED 1E5F0 "
    "1E7E0-1E7E6 1E7E8-1E7EB 1E7ED-1E7EE 1E7F0-1E7FE 2A6DE-2A6DF 2B735-2B739 2EBF0-2EE5D 31350-323AF"
)
NEW_NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 11F50-11F59 16130-16139 16AC0-16AC9 16D70-16D79 1CCF0-1CCF9 1D2C0-1D2D3 1E4F0-1E4F9 1E5F1-1E5FA"
WHITE = "9-D 20 85 A0 1680 2000-200A 2028-2029 202F 205F 3000"


def _class(ranges: str) -> str:
    return "".join("-".join(f"\\x{{{x}}}" for x in r.split("-")) for r in ranges.split())


def java_pattern(pattern: str) -> str:
    r"""A pattern of \p{L}, \p{N}, \s and \S, with the classes spelt for Java. The new ranges stand behind one test of their bounds."""
    new = lambda known, more: f"{known}[\\x{{870}}-\\x{{323AF}}&&[{_class(more)}]]"
    letters, numbers, white = new(r"\p{L}", NEW_LETTERS), new(r"\p{N}", NEW_NUMBERS), _class(WHITE)
    inner = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{white}{letters}{numbers}]")
    return inner.replace(r" ?\p{L}", f" ?[{letters}]").replace(r" ?\p{N}", f" ?[{numbers}]").replace(r"\S", f"[^{white}]").replace(r"\s", f"[{white}]")


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@functools.cache
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def letter_of(token: int) -> str:
    """The letter of a token, by its rank; none is a surrogate or one of the marks below FIRST."""
    return chr(FIRST + token + (0x800 if FIRST + token >= 0xD800 else 0))


def token_of(letter: Column) -> Column:
    code = F.ascii(letter)
    return F.when(code >= 0xD800 + 0x800, code - 0x800 - FIRST).otherwise(code - FIRST)


def _halves(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts that a token's merges end with."""
    parts = [token[k : k + 1] for k in range(len(token))]
    while len(parts) > 2:
        _, k = min((ranks.get(parts[k] + parts[k + 1], 1 << 60), k) for k in range(len(parts) - 1))
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return parts[0], parts[1]


def literal_map(pairs: Iterable[tuple[str, str]]) -> Column:
    """A literal of strings and their values, for found."""
    import xxhash

    buckets: list[dict] = [{} for _ in range(BUCKETS)]
    for key, value in pairs:
        buckets[xxhash.xxh64_intdigest(key.encode(), 42) & (BUCKETS - 1)][key] = value
    return F.from_json(F.lit(json.dumps(buckets, ensure_ascii=False, separators=(",", ":"))), "array<map<string,string>>")


def found(table: Column, key: Column) -> Column:
    """The value of a key in a literal map, null if it has none."""
    return F.try_element_at(F.get(table, F.xxhash64(key).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")), key)


@functools.cache
def merges_of(path: str) -> dict[str, str]:
    """Two letters -> the letter of what they become."""
    ranks = ranks_of(path)
    return {letter_of(ranks[a]) + letter_of(ranks[b]): letter_of(r) for t, r in ranks.items() if len(t) > 1 for a, b in [_halves(t, ranks)]}


def folded(word: Column, merges: Column, path: str) -> Column:
    """Letters of a word (not empty)."""
    ranks = ranks_of(path)
    merged = lambda two: F.coalesce(found(merges, two), F.lit(NONE))
    least = lambda r: F.array_min(F.split(r, ""))
    state = lambda p, r: F.struct(p.alias("p"), r.alias("r"), least(r).alias("m"))

    def step(acc: Column, _: Column) -> Column:
        def put(i: Column) -> Column:
            p = F.overlay(acc["p"], acc["m"], i, 2)
            return let(p, lambda p: let(F.overlay(acc["r"], F.concat(merged(F.substring(p, i - 1, 2)), merged(F.substring(p, i, 2))), i - 1, 3), lambda r: state(p, r)))

        return F.when(acc["m"] == NONE, acc).otherwise(let(F.instr(acc["r"], acc["m"]), put))

    def run(p: Column) -> Column:  # a mark at both ends, so that every letter has neighbours
        pairs = F.transform(F.sequence(F.lit(1), F.length(p) - 1), lambda i: merged(F.substring(p, i, 2)))
        last = let(F.array_join(pairs, ""), lambda r: F.aggregate(F.sequence(F.lit(4), F.length(p)), state(p, r), step, lambda acc: acc["p"]))
        return F.when(F.length(p) > 3, F.substring(last, F.lit(2), F.length(last) - 2)).otherwise(F.substring(p, F.lit(2), F.lit(1)))

    bytes_, letters = "".join(map(chr, range(256))), "".join(letter_of(ranks[bytes([b])]) for b in range(256))
    start = F.translate(F.decode(word.cast("binary"), "ISO-8859-1"), bytes_, letters)
    return let(F.concat(F.lit(MARK), start, F.lit(MARK)), run)


def words(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(java_pattern(pattern)), F.lit(0))


def frequent_words(texts: DataFrame, path: str, pattern: str, most: int = WORDS, sample: int = SAMPLE) -> Column:
    """A literal of the letters of the most frequent words in a sample of texts(_text)."""
    some = hashed_sample(texts, "_text", sample)
    counts = some.select(F.explode(words(F.col("_text"), pattern)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    best = counts.where(F.octet_length("word") <= WORD_BYTES).orderBy(F.desc("n"), "word").limit(most)
    merges = literal_map(merges_of(path).items())
    rows = best.select("word").repartition(12).select("word", let(merges, lambda m: folded(F.col("word"), m, path)).alias("letters"))
    return literal_map((r.word, r.letters) for r in rows.collect())  # most words of WORD_BYTES bytes at most


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word (not empty)."""
    if word in ranks:
        return [ranks[word]]
    if len(word) >= LONG:
        return _queued(word, ranks)
    parts = [word[k : k + 1] for k in range(len(word))]
    rank = [ranks.get(a + b, NO_RANK) for a, b in zip(parts, parts[1:])]
    while rank and (least := min(rank)) != NO_RANK:
        k = rank.index(least)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
        del rank[k]
        if k:
            rank[k - 1] = ranks.get(parts[k - 1] + parts[k], NO_RANK)
        if k < len(rank):
            rank[k] = ranks.get(parts[k] + parts[k + 1], NO_RANK)
    return [ranks[p] for p in parts]


def _queued(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same by a queue of (rank, start) of pairs; end[k] is where the part that begins at k ends, start_of[e] where the one that ends at e begins."""
    n = len(word)
    end, start_of = list(range(1, n + 1)), list(range(-1, n))
    queue = [(r, k) for k in range(n - 1) if (r := ranks.get(word[k : k + 2])) is not None]
    heapq.heapify(queue)
    while queue:
        r, k = heapq.heappop(queue)
        middle = end[k]
        if middle < 0 or middle == n or ranks.get(word[k : end[middle]]) != r:
            continue  # one of the two has been merged since
        last = end[middle]
        end[k], end[middle], start_of[last] = last, -1, k
        for a in (start_of[k] if k else -1, k):
            if a >= 0 and end[a] < n and (r := ranks.get(word[a : end[end[a]]])) is not None:
                heapq.heappush(queue, (r, a))
    out, k = [], 0
    while k < n:
        out.append(ranks[word[k : end[k]]])
        k = end[k]
    return out


class Rare:
    """Letters of words given in hexadecimal; at most REMEMBERED are remembered, and none of LONG bytes."""

    def __init__(self, path: str) -> None:
        self.ranks, self.known = ranks_of(path), {}

    def __call__(self, match: re.Match) -> str:
        word = match[1]
        out = self.known.get(word)
        if out is None:
            out = "".join(map(letter_of, encode_word(bytes.fromhex(word), self.ranks)))
            if len(word) < 2 * LONG:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[word] = out
        return out


def encode(docs: DataFrame, path: str, pattern: str | None = None, text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row."""
    pattern, kind = pattern or split_pattern(), docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", text_of(docs, text).alias("_text"))
    known = frequent_words(texts, path, pattern)
    # letters are above the hexadecimal digits of rare words, each of which ends with a blank
    each = lambda k: F.transform(words(F.col("_text"), pattern), lambda w: F.coalesce(found(k, w), F.concat(F.hex(w), F.lit(" "))))
    mixed = texts.select("doc_id", F.array_join(let(known, each), "").alias("_x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare, hexed = Rare(path), re.compile("([0-9A-F]+) ")
        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                part = b.slice(k, ROWS)
                found = [np.frombuffer(hexed.sub(rare, x).encode("utf-32-le"), "<u4").astype(np.int32) for x in part.column(1).to_pylist()]
                offsets = np.cumsum([0, *map(len, found)], dtype=np.int32)
                code = np.concatenate(found) if found else np.zeros(0, np.int32)
                ids = np.where(code >= 0xE000, code - 0x800, code) - FIRST
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return mixed.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decoded(ids: Column, path: str) -> Column:
    """The bytes of ids."""
    ranks = ranks_of(path)
    token = {r: t.hex() for t, r in ranks.items()}
    pieces = F.split(F.lit(",".join(token.get(k, "") for k in range(max(token) + 1))), ",")
    return let(pieces, lambda t: F.unhex(F.array_join(F.transform(ids, lambda i: F.when(i >= 0, F.get(t, i))), "")))


def digests(docs: DataFrame, path: str, pattern: str | None = None, text: str = "text") -> DataFrame:
    """Encodes every text and decodes its ids again: doc_id, n_tokens, and SHA-256 of the ids as decimals and of the decoded bytes."""
    rows = encode(docs, path, pattern, text)
    decimals = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimals, 256).alias("ids_sha256"), F.sha2(decoded(F.col("ids"), path), 256).alias("decoded_sha256"))
