"""What the tasks of ``curation.alike_texts`` compute on the token sets of whole texts, as numpy arrays of one batch.

Candidates are found on 32-bit hashes of the tokens. A set keeps one hash a token, so tokens that share a hash are counted
as often as they are: two sets share at least as many hashes as tokens, and no bound on hashes loses a pair. The sets of
what is left are compared token by token.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Counters of hashed tokens. They only rank tokens, so tokens that share one cost time, not results.
COUNTERS = 1 << 22
#: Counters of one row of the collected ranks.
CHUNK = 1 << 12


def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, at, n): the counters that a task's ``h`` reach, as 16-bit places in their chunk, and how often, as 32-bit numbers."""
    counts = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        counts += np.bincount(batch.column("h").flatten().to_numpy() & (COUNTERS - 1), minlength=COUNTERS)
    for chunk, part in enumerate(counts.reshape(-1, CHUNK)):
        at = np.flatnonzero(part)
        if len(at):
            yield pa.record_batch([pa.array([chunk], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (at.astype("<u2"), part[at].astype("<u4")))], ["chunk", "at", "n"])


def ranks(counts: pa.Table) -> pa.Table:
    """(chunk, ranks): a chunk's counters as a byte each, 0 where at most one set holds a token."""
    sums = np.zeros(CHUNK, np.int64)
    for at, n in zip(counts["at"].to_pylist(), counts["n"].to_pylist(), strict=True):
        sums[np.frombuffer(at, "<u2")] += np.frombuffer(n, "<u4")
    rank = np.minimum(np.ceil(8 * np.log2(np.maximum(sums, 1))), 255).astype(np.uint8)
    return pa.table({"chunk": counts["chunk"][:1], "ranks": pa.array([rank.tobytes()], pa.binary())})


def parity(hashes: np.ndarray) -> bytes:
    """A bit for each residue of the hashes, set if an odd number has it; about as many bits as hashes."""
    bits = 1 << max(6, (7 * len(hashes) // 10).bit_length())
    return np.packbits((np.bincount(hashes & (bits - 1), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def fewest(a: bytes, b: bytes) -> int:
    """The differing bits of two parities; each token of only one of the sets changes one, so no fewer tokens differ."""
    short, long = sorted((a, b), key=len)
    x, y, size = int.from_bytes(short, "little"), int.from_bytes(long, "little"), len(long)
    while size > len(short):  # a bit of half as many is the sum of two
        size //= 2
        y = (y >> (8 * size)) ^ (y & ((1 << (8 * size)) - 1))
    return (x ^ y).bit_count()


@F.pandas_udf(T.IntegerType())
def differing(a: pd.Series, b: pd.Series) -> pd.Series:
    """``fewest`` of each pair."""
    return pd.Series([fewest(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def prefixes(batches: Iterable[pa.RecordBatch], rank: bytes, percent: int) -> Iterator[pa.RecordBatch]:
    """(k, n, skip, p, bits): of each set the first n - ceil(percent * n / 100) + 1 hashes, rarest first, without the
    ``skip`` first ones, which no other set holds; and its parity."""
    order = np.frombuffer(rank, np.uint8)
    for batch in batches:
        hashes = batch.column("h").flatten().to_numpy()
        keys = (order[hashes & (COUNTERS - 1)].astype(np.uint64) << np.uint64(32)) | hashes.view(np.uint32)
        ends = np.cumsum(batch.column("n").to_numpy())
        skips, firsts, bits, low = [], [], [], 0
        for end in ends.tolist():
            n = end - low
            first = np.sort(keys[low:end])[: n - -(-percent * n // 100) + 1]
            skip = int(np.searchsorted(first, np.uint64(1 << 32)))
            skips.append(skip)
            firsts.append(first[skip:].astype(np.uint32).view(np.int32))
            bits.append(parity(hashes[low:end]))
            low = end
        offsets = np.concatenate([[0], np.cumsum([len(f) for f in firsts])])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *firsts]), pa.int32()))
        yield pa.record_batch([batch.column("k"), batch.column("n"), pa.array(skips, pa.int32()), lists, pa.array(bits, pa.binary())], ["k", "n", "skip", "p", "bits"])


def compared(pairs: pa.Table, sets: pa.Table, percent: int) -> pa.Table:
    """(rep_a, rep_b, common, total) of a cell's pairs with 100 * common >= percent * total, by their whole sets."""
    words = pa.concat_arrays(pc.split_pattern(sets["words"], " ").chunks)
    coded = words.flatten().dictionary_encode()
    held = np.zeros(len(coded.dictionary), bool)
    own = np.split(coded.indices.to_numpy(), np.cumsum(words.value_lengths().to_numpy())[:-1])
    row = {k: i for i, k in enumerate(sets["k"].to_pylist())}
    found, asks = [], None
    for a, b in zip(*(pairs.sort_by("a")[x].to_pylist() for x in "ab"), strict=True):
        if a != asks:
            if asks is not None:
                held[own[row[asks]]] = False
            held[own[row[a]]] = True
            asks = a
        x, y = row[a], row[b]
        common = int(np.count_nonzero(held[own[y]]))
        total = len(own[x]) + len(own[y]) - common
        if 100 * common >= percent * total:
            found.append((x, y, common, total))
    x, y, common, total = np.array(found, np.int64).reshape(-1, 4).T
    return pa.table({"rep_a": sets["rep"].take(pa.array(x)), "rep_b": sets["rep"].take(pa.array(y)), "common": common, "total": total})
