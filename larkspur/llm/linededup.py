"""Line dedup with two Bloom filters, for once-seen and twice-seen line hashes.

Every task fills a pair of filters over its own documents; pairs merge by (once | once', twice | twice' | once & once'),
which loses no repeat, whatever the order. The merged twice-seen filter has a bounded size and is broadcast.
Only lines that it suspects are shuffled: their digests are counted exactly, keys found in at least ``min_docs``
documents are confirmed, and their lines go from all documents but the one kept.

The filters are blocked: a hash's high bits choose a segment of 2**16 bits and ``PROBES`` positions lie inside it, so
that tasks ship segments, sparse ones as lists of positions, and segments merge in parallel. The size is chosen from the
number of lines up to ``MAX_SEGMENTS``; past that more lines are suspected and confirmed exactly, with the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .runtime import forget, small_batches, stored, with_python_columns

MIN_CHARS = 20
MIN_DOCS = 3
SEGMENT_BITS = 1 << 16
PROBES = 3
BYTES_PER_BIT = 8  # of text: a line of 100 bytes gets about 12 bits
MIN_SEGMENTS = 64
MAX_SEGMENTS = 8192  # 2**29 bits, 64 MB: the most that is ever broadcast
#: Confirmed keys up to this number (24 MB) are sent to all workers.
MAX_KEYS = 1_000_000
STRIP = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes | None:
    """The key of a line (UTF-8, A-Z already in lower case), or None where it has under ``MIN_CHARS`` code points."""
    key = line.strip(STRIP)
    if len(key) < MIN_CHARS or (len(key) < 4 * MIN_CHARS and len(key.decode("utf-8", "surrogatepass")) < MIN_CHARS):
        return None
    return key


def keys_of(text: str) -> list[bytes | None]:
    """Each line's key; bytes.lower changes A-Z only."""
    return [line_key(line) for line in text.encode("utf-8", "surrogatepass").lower().split(b"\n")]


def hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))


def places(h: np.ndarray, segments: int) -> np.ndarray:
    """Bit positions (hash x PROBES) in the whole filter; all of a hash's positions lie in one segment."""
    segment = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    inside = np.stack([(mixed >> np.uint64(16 * i)) & np.uint64(SEGMENT_BITS - 1) for i in range(PROBES)], axis=1)
    return (segment[:, None] * np.uint64(SEGMENT_BITS) + inside).astype(np.int64)


def held(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each row of positions, whether all bits are set."""
    return ((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def put(bitmap: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(bitmap, (at >> 3).ravel(), (np.uint8(1) << (at & 7).astype(np.uint8)).ravel())


class Filters:
    """A once-seen and a twice-seen filter of ``segments`` segments."""

    def __init__(self, segments: int):
        self.segments = segments
        self.once = np.zeros(segments * SEGMENT_BITS // 8, np.uint8)
        self.twice = np.zeros_like(self.once)

    def add(self, h: np.ndarray) -> None:
        """Add the hashes of some documents, each hash once a document."""
        h, n = np.unique(h, return_counts=True)
        at = places(h, self.segments)
        put(self.twice, at[(n > 1) | held(self.once, at)])
        put(self.once, at)

    def parts(self) -> Iterator[tuple[int, bytes, bytes]]:
        """(segment, once, twice) of the segments that hold anything."""
        size = SEGMENT_BITS // 8
        for i in np.flatnonzero(self.once.reshape(self.segments, size).any(axis=1)).tolist():
            yield i, pack(self.once[i * size : (i + 1) * size]), pack(self.twice[i * size : (i + 1) * size])


def pack(bitmap: np.ndarray) -> bytes:
    """A segment as a list of 16-bit positions where that is shorter, else as its bitmap."""
    on = np.flatnonzero(np.unpackbits(bitmap, bitorder="little"))
    return b"p" + on.astype("<u2").tobytes() if len(on) < SEGMENT_BITS // 16 else b"b" + bitmap.tobytes()


def unpack(data: bytes) -> np.ndarray:
    if data[:1] == b"b":
        return np.frombuffer(data, np.uint8, offset=1).copy()
    bits = np.zeros(SEGMENT_BITS, np.uint8)
    bits[np.frombuffer(data, "<u2", offset=1)] = 1
    return np.packbits(bits, bitorder="little")


def build_filter(texts: DataFrame, segments: int) -> np.ndarray:
    """The twice-seen filter over all rows of ``texts`` (one string column), merged segment by segment."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filters = Filters(segments)
        for batch in batches:
            for at in range(0, len(batch), 512):
                own = [list({k for k in keys_of(t) if k}) for t in batch["text"].iloc[at : at + 512] if t]
                if any(own):
                    filters.add(np.concatenate([hashes(k) for k in own]))
        rows = []
        for part in filters.parts():
            rows.append(part)
            if len(rows) == 256:
                yield pd.DataFrame(rows, columns=["segment", "once", "twice"])
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=["segment", "once", "twice"])

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for segment, once, twice in batch.itertuples(index=False):
                once, twice = unpack(once), unpack(twice)
                old = pairs.get(segment)
                if old is None:
                    pairs[segment] = [once, twice]
                else:
                    old[1] |= twice | (old[0] & once)
                    old[0] |= once
        for segment, (_, twice) in pairs.items():
            if twice.any():
                yield pd.DataFrame([(segment, pack(twice))], columns=["segment", "twice"])

    small_batches(texts.sparkSession)
    parts = texts.mapInPandas(build, "segment int, once binary, twice binary")
    merged = parts.repartition("segment").mapInPandas(merge, "segment int, twice binary")
    twice, size = np.zeros(segments * SEGMENT_BITS // 8, np.uint8), SEGMENT_BITS // 8
    for row in merged.toLocalIterator():
        twice[row.segment * size : (row.segment + 1) * size] = unpack(bytes(row.twice))
    return twice


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


class Suspicion:
    """The twice-seen filter of a corpus, shared with all workers: which keys of a text may repeat elsewhere."""

    def __init__(self, texts: DataFrame):
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.segments = int(min(MAX_SEGMENTS, max(MIN_SEGMENTS, size // BYTES_PER_BIT // SEGMENT_BITS)))
        self.shared = texts.sparkSession.sparkContext.broadcast(build_filter(texts, self.segments))

    def suspected(self, keys: list[bytes]) -> list[bytes]:
        return [k for k, h in zip(keys, held(self.shared.value, places(hashes(keys), self.segments)), strict=True) if h] if keys else []


class Confirmed:
    """Confirmed keys and the ids that keep them, as sorted arrays: 24 bytes a key, looked up for many keys at once."""

    def __init__(self, digests: list[bytes], homes: list[int]):
        parts = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
        order = np.argsort(parts[:, 0], kind="stable")
        self.first, self.second, self.home = parts[order, 0], parts[order, 1], np.array(homes, np.int64)[order]

    def lost(self, digests: list[bytes], doc_id: int | None) -> list[bytes]:
        """Those of ``digests`` that are confirmed and kept by another document."""
        out = []
        parts = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
        for d, at, end, second in zip(digests, np.searchsorted(self.first, parts[:, 0]), np.searchsorted(self.first, parts[:, 0], "right"), parts[:, 1], strict=True):
            if any(self.second[i] == second and self.home[i] != doc_id for i in range(at, end)):
                out.append(d)
        return out


def suspected_lines(rows: DataFrame, suspicion: Suspicion) -> DataFrame:
    """(doc_id, key): the digests of all suspected lines, once a row of ``rows`` (doc_id, text)."""

    def suspects(texts):
        for text in texts:
            yield ([digest(k) for k in suspicion.suspected(list({k for k in keys_of(text or "") if k}))],)

    found = with_python_columns(rows, ["text"], {"keys": "array<binary>"}, suspects, drop=("text",))
    return found.select("doc_id", F.explode("keys").alias("key"))


def without_lines(text: str, gone: set[bytes]) -> tuple[str, int, int]:
    """(kept text, lines before, lines dropped)."""
    lines = text.split("\n")
    stay = [x for x, k in zip(lines, keys_of(text), strict=True) if k is None or digest(k) not in gone]
    return "\n".join(stay), len(lines), len(lines) - len(stay)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """All columns of ``docs`` but the text as the struct ``row``, with kept (the new text), n_lines and n_dropped.

    Null or empty text is one empty line and stays empty; texts and lines of any length are read whole. Documents are told
    apart by id: repeated rows of an id count once and lose the same lines; rows without an id never count and lose every
    confirmed line. A line that repeats within one document only stays. An empty table gives no rows; other columns pass
    through under any name.

    Up to ``MAX_KEYS`` confirmed keys are sent to all workers, so that no text is moved; more of them (or ids that are no
    integers) are brought to their documents by a join on the id.
    """
    rows = docs.select(F.struct(*(c for c in docs.columns if c != text_col)).alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    suspicion = Suspicion(rows.select("text"))
    pairs = stored(suspected_lines(rows.select("doc_id", "text"), suspicion), "line-suspects")
    # stored, so that the join below has nothing but an exchange under either side and Spark can split a hot key
    repeated = stored(pairs.groupBy("key").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("home")).where(F.col("n") >= min_docs).select("key", "home"), "repeated-lines")
    outputs = {"kept": "string", "n_lines": "long", "n_dropped": "long"}
    if isinstance(rows.schema["doc_id"].dataType, IntegralType) and repeated.count() <= MAX_KEYS:
        table = repeated.toArrow()
        known = docs.sparkSession.sparkContext.broadcast(Confirmed(table["key"].to_pylist(), table["home"].to_pylist()))
        forget(pairs)
        forget(repeated)

        def cut(texts, ids):
            for text, doc_id in zip(texts, ids, strict=True):
                maybe = [digest(k) for k in suspicion.suspected(list({k for k in keys_of(text) if k}))]
                gone = known.value.lost(maybe, doc_id) if maybe else []
                yield without_lines(text, set(gone)) if gone else (text, text.count("\n") + 1, 0)

        return with_python_columns(rows, ["text", "doc_id"], outputs, cut, drop=("text", "doc_id"))

    lost = pairs.join(repeated, "key").where(~F.col("doc_id").eqNullSafe(F.col("home")))
    drops = lost.groupBy("doc_id").agg(F.collect_set("key").alias("drop")).select(F.col("doc_id").alias("drop_id"), "drop")
    joined = rows.join(drops, F.col("doc_id").eqNullSafe(F.col("drop_id")), "left").select("row", "text", "drop")

    def cut_joined(texts, drops):
        for text, drop in zip(texts, drops, strict=True):
            yield without_lines(text, set(drop)) if drop else (text, text.count("\n") + 1, 0)

    return with_python_columns(joined, ["text", "drop"], outputs, cut_joined, drop=("text", "drop"))


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the kept text in place of the text (null text becomes empty); all rows and columns stay."""
    done = dedup_lines(docs, id_col, text_col, min_docs)
    return done.select(*(F.col("kept").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))
