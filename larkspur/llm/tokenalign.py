"""Cross-tokenizer alignment by id-striped dense count matrices.

Two tokenizers cut the same bytes. Where a token of A and one of B end at the same byte, the two are linked, and the
tokens up to there form a group. How often each pair of ids is linked in the corpus tells which A id is the best match
of a B id.

- Each batch of texts is encoded once. Its links are folded to (text, pair, times) and stored by the stripe of the B id
  (the id modulo ``STRIPES``, which spreads frequent ids that have neighbouring numbers).
- Counts are folded within each task, then shuffled by stripe; a task adds them with ``np.add.at`` into the stripe's
  dense matrix (B ids of the stripe x all A ids), whose row maxima give the best matches.
- The counts of a stripe and its links meet in one partition: the counts first, then the links as they stream by.
  Stripes with many links are salted, and their counts copied to each part.

A task holds one matrix (its size is set by the vocabularies) and one batch, whatever the corpus holds.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Vocabulary, merge_long
from .runtime import Scratch, new_folder, small_batches

STRIPES = 128
#: A pair is one number: the B id, then ``A_BITS`` bits of the A id.
A_BITS = 16
#: Texts of one slice of a batch; their links are sorted at once.
SLICE = 256
#: Pairs that a task holds before it folds them, and pairs of one row of counts.
FOLD_AT = 1 << 21
ROW_PAIRS = 1 << 18
#: Words of more characters are merged by the heap, as the library's time grows with their square.
LONG_WORD = 2000


class ByteLevel:
    """A: byte-level BPE ids of a space and the text, and the bytes of each id."""

    def __init__(self, path: str):
        self.vocabulary = v = Vocabulary(path)
        # merged ids are numbered in the order of their merges, so ranks and ids sort alike
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in v.bytes.items() if i not in v.special.values()}, special_tokens={})
        self.bytes = [v.bytes.get(i, b"") for i in range(max(v.bytes) + 1)]
        self.words, self.blanks = regex.compile(public_tokenizers.PATTERN), re.compile(rf"\s{{{LONG_WORD}}}")

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.by_words(t) if self.may_be_long(t) else self.encoding.encode_ordinary(t) for t in (" " + t for t in texts)]

    def may_be_long(self, text: str) -> bool:
        """Whether a word may have over ``LONG_WORD`` characters; the ids are the same either way."""
        return len(text) > LONG_WORD and (max(map(len, text.split()), default=0) >= LONG_WORD or self.blanks.search(text) is not None)

    def by_words(self, text: str) -> list[int]:
        out = []
        for word in self.words.findall(text):
            out += merge_long(word.encode(), self.vocabulary) if len(word) > LONG_WORD else self.encoding.encode_ordinary(word)
        return out


class Pieces:
    """B: sentence pieces with byte fallback, and the bytes of each id."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        names = [self.model.id_to_piece(i) for i in ids]
        self.bytes = [bytes((int(names[i][3:5], 16),)) if self.model.is_byte(i) else names[i].replace("▁", " ").encode() for i in ids]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Aligner:
    """Encodes texts by both tokenizers and cuts them where tokens end together."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.lengths = [np.array([len(x) for x in side.bytes], dtype=np.int64) for side in (self.a, self.b)]
        most = max(map(len, self.lengths))
        self.written = np.array([[f"{i}{sign}" for i in range(most)] for sign in ",|;"], dtype=object)

    def tokens(self, texts: list[str | None]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids by A and B of each text; none for null and empty texts and where either side's bytes are not the text's."""
        whole = [t or "" for t in texts]
        for text, a, b in zip(whole, self.a.encode(whole), self.b.encode(whole), strict=True):
            # A's tokens are cut from the bytes of the text themselves, so only B's can differ from them
            same = text and b"".join(map(self.b.bytes.__getitem__, b)) == b" " + text.encode()
            yield (a, b) if same else ([], [])

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the A and the B tokens that end together."""
        _, in_a, in_b = np.intersect1d(self.lengths[0][a].cumsum(), self.lengths[1][b].cumsum(), assume_unique=True, return_indices=True)
        return in_a, in_b

    def listed(self, a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2,b3``: each group's A ids, then its B ids."""
        signs_a, signs_b = np.zeros(len(a), np.int8), np.zeros(len(b), np.int8)
        signs_a[in_a], signs_b[in_b] = 1, 2
        # an A token goes behind the B tokens of all groups before its own, a B token behind the A tokens up to its own group
        ends_a, ends_b = in_a + 1, in_b + 1
        own_a, own_b = np.searchsorted(in_a, np.arange(len(a))), np.searchsorted(in_b, np.arange(len(b)))
        out = np.empty(len(a) + len(b), dtype=object)
        out[np.arange(len(a)) + np.concatenate(([0], ends_b))[own_a]] = self.written[signs_a, a]
        out[np.arange(len(b)) + ends_a[own_b]] = self.written[signs_b, b]
        return "".join(out.tolist())[:-1]


@functools.cache
def aligner(a_path: str, b_path: str) -> Aligner:
    """One a worker process."""
    return Aligner(a_path, b_path)


def folded(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sum of ``times`` of each."""
    different, place = np.unique(keys, return_inverse=True)
    total = np.zeros(len(different), np.int64)
    np.add.at(total, place, times)
    return different, total


def cut_by(parts: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(value, where it stands) of each run of equal values."""
    if len(parts):
        starts = np.concatenate(([0], np.flatnonzero(np.diff(parts)) + 1, [len(parts)]))
        for low, high in zip(starts, starts[1:], strict=False):
            yield int(parts[low]), slice(low, high)


TEXTS = "kind string, batch long, place int, doc_id {id_type}, n_a long, n_b long, n_groups long, groups_sha256 string, stripe int, places binary, pairs binary, times binary, n_pairs long"


def encoded(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Of kind ``text`` a row for each text (batch and place name it); of kind ``link`` a row for each slice and stripe,
    with the places of texts, pairs and times as packed arrays. ``docs``: row (different numbers), doc_id, text."""
    schema = docs.limit(0).select("doc_id").schema["doc_id"]
    spec = TEXTS.format(id_type=schema.dataType.simpleString())
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(a_path, b_path)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                name, made, keys, times = part.column("row")[0].as_py(), [], [], []
                for place, (a, b) in enumerate(align.tokens(part.column("text").to_pylist())):
                    a, b = np.array(a, np.int64), np.array(b, np.int64)
                    in_a, in_b = align.groups(a, b)
                    made.append((len(a), len(b), len(in_a), hashlib.sha256(align.listed(a, b, in_a, in_b).encode()).hexdigest() if len(a) else ""))
                    pairs, n = np.unique(b[in_b] << A_BITS | a[in_a], return_counts=True)
                    keys.append((pairs >> A_BITS) % STRIPES << 48 | place << 32 | pairs)
                    times.append(n)
                n, ids = part.num_rows, part.column("doc_id")
                columns = list(zip(*made, strict=True))
                yield packed(batch_schema(ids.type), n, kind=["text"] * n, batch=[name] * n, place=range(n), doc_id=ids, n_a=columns[0], n_b=columns[1], n_groups=columns[2], groups_sha256=columns[3])
                keys, times = np.concatenate(keys), np.concatenate(times)
                order = np.argsort(keys, kind="stable")
                keys, times = keys[order], times[order].astype(np.int32)
                rows = [(s, (keys[w] >> 32 & 0xFFFF).astype(np.uint16).tobytes(), (keys[w] & 0xFFFFFFFF).astype(np.uint32).tobytes(), times[w].tobytes(), w.stop - w.start) for s, w in cut_by(keys >> 48)]
                if rows:
                    stripes, places, pairs, counts, many = zip(*rows, strict=True)
                    yield packed(batch_schema(ids.type), len(rows), kind=["link"] * len(rows), batch=[name] * len(rows), stripe=stripes, places=places, pairs=pairs, times=counts, n_pairs=[int(x) for x in many])

    return docs.mapInArrow(run, spec)


def batch_schema(id_type: pa.DataType) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.strip().split(" ") for f in TEXTS.split(",")]
    return pa.schema([(name, id_type if name == "doc_id" else kinds[kind]) for name, kind in fields])


def packed(schema: pa.Schema, rows: int, **columns) -> pa.RecordBatch:
    """A batch of the given columns; the others are null."""
    return pa.RecordBatch.from_arrays([(v if isinstance(v := columns[f.name], pa.Array) else pa.array(list(v), f.type)) if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)


COUNTS = pa.schema([("stripe", pa.int32()), ("pairs", pa.binary()), ("counts", pa.binary())])


def count_rows(pairs: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counted pairs as rows of their stripes."""
    stripes = (pairs >> A_BITS) % STRIPES
    order = np.argsort(stripes, kind="stable")
    pairs, counts, stripes = pairs[order].astype(np.uint32), counts[order].astype(np.int64), stripes[order]
    for stripe, where in cut_by(stripes):
        for at in range(where.start, where.stop, ROW_PAIRS):
            some = slice(at, min(at + ROW_PAIRS, where.stop))
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((stripe, pairs[some].tobytes(), counts[some].tobytes()), COUNTS.types, strict=True)], schema=COUNTS)


def within_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a task folded to counted pairs before they are shuffled."""
    pairs, counts, held = [], [], 0
    for batch in batches:
        for p, t in zip(batch.column("pairs"), batch.column("times"), strict=True):
            pairs.append(np.frombuffer(p.as_buffer(), np.uint32).astype(np.int64))
            counts.append(np.frombuffer(t.as_buffer(), np.int32).astype(np.int64))
            held += len(pairs[-1])
        if held > FOLD_AT:
            one = folded(np.concatenate(pairs), np.concatenate(counts))
            pairs, counts, held = [one[0]], [one[1]], len(one[0])
            if held > FOLD_AT // 2:
                yield from count_rows(*one)
                pairs, counts, held = [], [], 0
    if held:
        yield from count_rows(*folded(np.concatenate(pairs), np.concatenate(counts)))


class Matrix:
    """Counts of one stripe: a row for each of its B ids, a column for each A id."""

    def __init__(self):
        self.cells, self.best = np.zeros((0, 1 << A_BITS), np.int64), None

    def place(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = (pairs >> A_BITS) // STRIPES
        if len(rows) and (top := int(rows.max()) + 1) > len(self.cells):
            grown = np.zeros((max(top, 1 << (top - 1).bit_length()), 1 << A_BITS), np.int64)
            grown[: len(self.cells)] = self.cells
            self.cells = grown
        return rows, pairs & ((1 << A_BITS) - 1)

    def add(self, pairs: bytes, counts: bytes) -> None:
        where = self.place(np.frombuffer(pairs, np.uint32).astype(np.int64))
        np.add.at(self.cells, where, np.frombuffer(counts, np.int64))
        self.best = None

    def score(self, pairs: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Count of each pair, and whether no A id is linked more often with its B id."""
        if self.best is None:
            self.best = self.cells.max(axis=1)
        rows, columns = self.place(np.frombuffer(pairs, np.uint32).astype(np.int64))
        counts = self.cells[rows, columns]
        return counts, counts == self.best[rows]


def whole_stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts, in the order of their stripes, added up."""
    stripe, matrix = None, None
    for batch in batches:
        for s, pairs, counts in zip(*(batch.column(c).to_pylist() for c in COUNTS.names), strict=True):
            if s != stripe:
                if matrix is not None:
                    yield from stripe_counts(stripe, matrix)
                stripe, matrix = s, Matrix()
            matrix.add(pairs, counts)
    if matrix is not None:
        yield from stripe_counts(stripe, matrix)


def stripe_counts(stripe: int, matrix: Matrix) -> Iterator[pa.RecordBatch]:
    rows, columns = matrix.cells.nonzero()
    yield from count_rows((rows * STRIPES + stripe) << A_BITS | columns, matrix.cells[rows, columns])


SCORES = pa.schema([("batch", pa.int64()), ("place", pa.int32()), ("n_best", pa.int64()), ("count_sum", pa.int64())])


def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each part of a stripe: its counts, then its links, which give sums for their texts."""
    part, matrix = None, None
    for batch in batches:
        names, places, sums = [], [], []
        for stripe, salt, name, spots, pairs, values in zip(*(batch.column(c).to_pylist() for c in ("stripe", "salt", "batch", "places", "pairs", "values")), strict=True):
            if (stripe, salt) != part:
                part, matrix = (stripe, salt), Matrix()
            if name is None:
                matrix.add(pairs, values)
                continue
            counts, best = matrix.score(pairs)
            times, at = np.frombuffer(values, np.int32).astype(np.int64), np.frombuffer(spots, np.uint16)
            total = np.zeros((2, SLICE), np.int64)
            np.add.at(total[0], at, times * best)
            np.add.at(total[1], at, times * counts)
            met = np.flatnonzero(total[1])
            names.append(np.full(len(met), name, np.int64))
            places.append(met)
            sums.append(total[:, met])
        if names:
            n_best, count_sum = np.concatenate(sums, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((np.concatenate(names), np.concatenate(places).astype(np.int32), n_best, count_sum), SCORES.types, strict=True)], schema=SCORES)


def kept(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """``df`` written to the shared folder, in a folder for each value of ``by``, and read back; deleted with the scratch."""
    path = new_folder(df.sparkSession, label)
    writer = df.write.partitionBy(by) if by else df.write
    writer.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._larkspur_path = path
    Scratch._open[-1].made.append(back)
    return back


def in_order(df: DataFrame, keys: list[str], order: list[str], run: Callable, schema: str) -> DataFrame:
    """Rows dealt out by ``keys`` and streamed in order through ``run``."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def pair_counts(links: DataFrame) -> DataFrame:
    """(stripe, pairs, counts): how often each pair is linked, as packed arrays."""
    partial = links.select("pairs", "times").mapInArrow(within_tasks, "stripe int, pairs binary, counts binary")
    return in_order(partial, ["stripe"], [], whole_stripes, "stripe int, pairs binary, counts binary")


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a and n_b (tokens), n_groups, n_links, n_best (links that no A id beats for their
    B id), count_sum (corpus-wide counts of its links) and groups_sha256.

    Null and empty texts, and texts that either tokenizer does not give back byte for byte, have no tokens: zeros and an
    empty digest. A ids that tie as best of a B id are all best. Rows repeated with one id each count and get a row each.
    Texts of any length are encoded whole; an empty table gives no rows; other columns are ignored.
    """
    with Scratch() as scratch:
        rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        both = kept(encoded(rows, a_path, b_path), "encoded", "kind")
        scratch.keep(both)
        links = both.where("kind = 'link'")
        counts = kept(pair_counts(links), "pair-counts")
        # at most STRIPES rows: how many parts each stripe's links need
        sizes = {r.stripe: r.n for r in links.groupBy("stripe").agg(F.sum("n_pairs").alias("n")).collect()}
        mean = sum(sizes.values()) / max(len(sizes), 1)
        parts = F.create_map(*(F.lit(x) for s, n in sizes.items() for x in (s, max(1, round(n / mean))))) if sizes else F.create_map(F.lit(0), F.lit(1))
        salted = links.select("stripe", F.pmod(F.xxhash64("batch"), parts[F.col("stripe")]).cast("int").alias("salt"), "batch", "places", "pairs", F.col("times").alias("values"))
        copied = counts.select("stripe", F.explode(F.sequence(F.lit(0), parts[F.col("stripe")] - 1)).alias("salt"), F.lit(None).cast("long").alias("batch"), F.lit(None).cast("binary").alias("places"), "pairs", F.col("counts").alias("values"))
        # a null batch sorts first
        sums = in_order(copied.unionByName(salted), ["stripe", "salt"], ["batch"], scored, "batch long, place int, n_best long, count_sum long")
        sums = scratch.keep(kept(sums.groupBy("batch", "place").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")), "link-sums"))
    texts = both.where("kind = 'text'").select("batch", "place", "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "groups_sha256")
    out = texts.join(sums.hint("merge"), ["batch", "place"], "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")), "groups_sha256")
