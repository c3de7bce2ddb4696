"""Byte-level BPE encoding and decoding with a contiguous rank array per short word.

A word is held as its parts, a token id between each two boundaries, and beside each inner boundary the rank of merging
across it; the encoder scans the ranks for the minimum, deletes that boundary and refreshes the two neighbouring ranks.
Words over ``LONG_WORD`` bytes use the same merges through a heap over linked parts, so that a very long word costs
n log n.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import with_python_columns

#: Splits text before the merges (fixed value of the vocabulary's byte-level pre-tokeniser).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NO_RANK = 1 << 30
SHIFT = 20
LONG_WORD = 256
#: Memory that each half of a worker's word cache may take, by the lengths of words and ids and the cost of an entry.
CACHE_BYTES = 64 << 20
ENTRY_BYTES = 200


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files, as {character: byte}."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Merge ranks, ids and special tokens of a byte-level BPE file; plain data, cheap to broadcast."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        to_byte = byte_alphabet()
        raw = lambda token: bytes(to_byte[c] for c in token)
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.ids = {raw(t): i for t, i in data["model"]["vocab"].items() if t not in self.special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        self.byte_ids = [self.ids[bytes((b,))] for b in range(256)]
        #: rank of each pair of ids (packed into one number), and the id that each rank makes
        self.ranks = {self.ids[raw(a)] << SHIFT | self.ids[raw(b)]: n for n, (a, b) in reversed(list(enumerate(merges)))}
        self.made = [self.ids[raw(a) + raw(b)] for a, b in merges]
        self.bytes = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}


def merge_short(word: bytes, v: Vocabulary) -> list[int]:
    """Ids of ``word`` after all merges, by repeated minimum scans of the rank array."""
    ids, ranks, made = [v.byte_ids[b] for b in word], v.ranks.get, v.made
    rank = [ranks(a << SHIFT | b, NO_RANK) for a, b in zip(ids, ids[1:], strict=False)]
    while rank:
        least = min(rank)
        if least == NO_RANK:
            break
        i = rank.index(least)
        ids[i] = made[least]
        del ids[i + 1], rank[i]
        if i < len(rank):
            rank[i] = ranks(ids[i] << SHIFT | ids[i + 1], NO_RANK)
        if i:
            rank[i - 1] = ranks(ids[i - 1] << SHIFT | ids[i], NO_RANK)
    return ids


def merge_long(word: bytes, v: Vocabulary) -> list[int]:
    """The same merges (least rank first, leftmost on ties) with a heap over linked parts, for words of any length."""
    n = len(word)
    ids, after, before = [v.byte_ids[b] for b in word], list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (r := v.ranks.get(ids[i] << SHIFT | ids[j])) is not None:
            heapq.heappush(heap, (r, i, ids[i], ids[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        r, i, left, right = heapq.heappop(heap)
        j = after[i]
        if ids[i] != left or j >= n or ids[j] != right:
            continue
        ids[i], ids[j], after[i] = v.made[r], -1, after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [x for x in ids if x >= 0]


class Encoder:
    """Encodes and decodes texts; keeps the ids (as decimal text) of words met lately.

    New words go to the young half; when it holds ``CACHE_BYTES`` it becomes the old half, and the old one is dropped.
    Words found in the old half move to the young one, so frequent words stay.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.words = regex.compile(PATTERN)
        self.cuts = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None
        self.decimal = {str(i): t for i, t in vocabulary.bytes.items()}
        self.cache: dict[str, str] = {}
        self.held = 0
        self.old: dict[str, str] = {}

    def word(self, word: str) -> str:
        """The ids of a word that the young half does not hold."""
        out = self.old.get(word)
        if out is None:
            raw = word.encode()
            out = ",".join(map(str, (merge_short if len(raw) <= LONG_WORD else merge_long)(raw, self.v)))
        if len(word) <= LONG_WORD:
            size = 2 * len(word) + len(out) + ENTRY_BYTES
            if self.held + size > CACHE_BYTES:
                self.old = dict(self.cache)
                self.cache.clear()
                self.held = 0
            self.cache[word] = out
            self.held += size
        return out

    def listed(self, text: str) -> str:
        """The ids of a text in decimal, joined by commas."""
        get, new = self.cache.get, self.word
        if not (self.cuts and any(s in text for s in self.v.special)):
            return ",".join([get(w) or new(w) for w in self.words.findall(text)])
        out = []
        for piece in self.cuts.split(text):
            special = self.v.special.get(piece)
            out += [str(special)] if special is not None else [get(w) or new(w) for w in self.words.findall(piece)]
        return ",".join(out)

    def encode(self, text: str) -> list[int]:
        listed = self.listed(text)
        return list(map(int, listed.split(","))) if listed else []

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.v.bytes.__getitem__, ids)).decode("utf-8", "replace")

    def decode_listed(self, listed: str) -> str:
        return b"".join(map(self.decimal.__getitem__, listed.split(","))).decode("utf-8", "replace") if listed else ""


_ENCODERS: dict[str, Encoder] = {}


def encoder_for(key: str, vocabulary: Callable[[], Vocabulary]) -> Encoder:
    """One encoder a worker process, so that its word cache serves all its tasks."""
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(vocabulary())
    return _ENCODERS[key]


def load(spark: SparkSession, path: str):
    """The vocabulary of ``path`` as a broadcast (its size is that of the file, about 50,000 entries)."""
    return spark.sparkContext.broadcast(Vocabulary(path))


def encode_documents(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>) and the text decoded from them, one row per document in any order.

    Null text is encoded as empty (no ids, empty decoded text). Rows and ids may repeat and are encoded each; of equal
    ranks the leftmost is merged first. Texts of any length are encoded whole. An empty table gives no rows; other
    columns are ignored.
    """
    shared = load(docs.sparkSession, vocabulary_path)

    def make(texts):
        encoder = encoder_for(vocabulary_path, lambda: shared.value)
        for text in texts:
            ids = encoder.encode(text or "")
            yield ids, encoder.decode(ids)

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return with_python_columns(narrow, ["text"], {"ids": "array<int>", "decoded": "string"}, make, drop=("text",))


def digest_documents(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas) and decoded_sha256, without shipping the ids.

    Nulls, ties, repeats, long texts, empty tables and extra columns as in ``encode_documents``.
    """
    shared = load(docs.sparkSession, vocabulary_path)

    def make(texts):
        encoder = encoder_for(vocabulary_path, lambda: shared.value)
        for text in texts:
            listed = encoder.listed(text or "")
            n_tokens = listed.count(",") + 1 if listed else 0
            yield n_tokens, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(encoder.decode_listed(listed).encode()).hexdigest()

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return with_python_columns(narrow, ["text"], {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}, make, drop=("text",))
