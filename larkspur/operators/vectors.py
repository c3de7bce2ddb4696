"""Nearest neighbours of one block of vectors among vectors that stream past it, exact and bounded in memory."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Rows of the block and of the stream whose products are held at once, and pairs whose scores are.
TILE, CHUNK, PAIRS = 512, 1024, 8192


def in_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products summed in the order of the places, so that equal vectors get equal scores in all blocks."""
    out = np.zeros(len(x))
    for place in range(x.shape[1]):
        out += x[:, place] * y[:, place]
    return out


def candidates(x: np.ndarray, y: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of unit vectors that may score ``floor`` of their row or more; those left out do not, as the
    products are lowered by what they may be off. Rows without a floor take that of their k + 1 best pairs here."""
    slack = (x.shape[1] + 8) * float(np.finfo(x.dtype).eps)
    near = x @ y.T
    rows = np.flatnonzero(near.max(axis=1) >= floor - slack)
    near, low = near[rows], floor[rows] - slack
    new = np.isneginf(low)
    if near.shape[1] > k + 1 and new.any():
        low[new] = np.partition(near[new], -k - 1, axis=1)[:, -k - 1] - 2 * slack
    i, j = np.divmod(np.flatnonzero(near >= low.astype(x.dtype)[:, None]), len(y))
    return rows[i], j


class Best:
    """The ``k`` best neighbours so far of each row of a block; of equal scores those of smaller ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.k = k
        self.ids, self.vectors, self.root, self.unit = self.usable(ids, vectors)
        self.single = self.unit.astype(np.float32)
        self.floor = np.full(len(self.ids), -np.inf)
        self.found = (np.empty(0, np.int64), self.ids[:0], np.empty(0))
        self.new: list[tuple] = []
        self.waiting = 0

    @staticmethod
    def usable(ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, ...]:
        """Ids, vectors, lengths and unit vectors of the rows that have a direction."""
        vectors = vectors.astype(np.float64)
        root = np.sqrt(in_order(vectors, vectors))
        with np.errstate(all="ignore"):
            unit = vectors / root[:, None]
        good = np.isfinite(unit).all(axis=1)
        return ids[good], vectors[good], root[good], unit[good]

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        ids, vectors, root, unit = self.usable(ids, vectors)
        if not len(ids):
            return
        single, pairs, waiting = unit.astype(np.float32), [], 0
        for start in range(0, len(self.ids), TILE):
            at = slice(start, start + TILE)
            i, j = candidates(self.single[at], single, self.floor[at], self.k)
            if len(i) * 16 > len(self.ids[at]) * len(ids):  # many are too close for single precision
                i, j = candidates(self.unit[at], unit, self.floor[at], self.k)
            pairs.append((i + start, j))
            waiting += len(i)
            if waiting and (waiting >= PAIRS or start + TILE >= len(self.ids)):
                self.score(*(np.concatenate(c) for c in zip(*pairs, strict=True)), ids, vectors, root)
                pairs, waiting = [], 0

    def score(self, i: np.ndarray, j: np.ndarray, ids: np.ndarray, vectors: np.ndarray, root: np.ndarray) -> None:
        for part in range(0, len(i), PAIRS):
            a, b = i[part : part + PAIRS], j[part : part + PAIRS]
            with np.errstate(all="ignore"):
                score = in_order(self.vectors[a], vectors[b]) / self.root[a] / root[b]
            kept = (self.ids[a] != ids[b]) & (score >= self.floor[a])
            self.new.append((a[kept], ids[b][kept], score[kept]))
            self.waiting += len(self.new[-1][0])
            if self.waiting > len(self.ids) * self.k:
                self.merge()

    def merge(self) -> None:
        i, near, score = (np.concatenate(c) for c in zip(self.found, *self.new, strict=True))
        order = np.lexsort((near, -score, i))
        i, near, score = i[order], near[order], score[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        self.floor[i[rank == self.k - 1]] = score[rank == self.k - 1]
        kept = rank < self.k
        self.found, self.new, self.waiting = (i[kept], near[kept], score[kept]), [], 0

    def rows(self, kind: pa.DataType) -> pa.RecordBatch:
        self.merge()
        i, near, score = self.found
        return pa.RecordBatch.from_arrays([pa.array(self.ids[i], kind), pa.array(near, kind), pa.array(score)], names=["id", "near_id", "score"])


def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray, pa.DataType]]:
    """(cell, whether rows of its block, ids, vectors, type of ids) for each run of rows of a kind, at most ``CHUNK`` long."""
    for batch in batches:
        cell, asked = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "asked"))
        ends = np.flatnonzero((np.diff(cell) != 0) | (np.diff(asked.astype(np.int8)) != 0)) + 1
        for start, end in itertools.pairwise([0, *ends.tolist(), len(cell)]):
            for at in range(start, end, CHUNK):
                part = batch.slice(at, min(CHUNK, end - at))
                v = part.column("v")
                sizes = np.diff(v.offsets.to_numpy())
                if (sizes != sizes[0]).any():
                    raise ValueError("vectors of different lengths")
                yield int(cell[at]), bool(asked[at]), part.column("id").to_numpy(zero_copy_only=False), v.flatten().to_numpy(zero_copy_only=False).reshape(len(sizes), -1), part.column("id").type


def search(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(id, near_id, score) of the best ``k`` of each block row, from rows (cell, asked, id, v) sorted by cell, the block's
    rows (``asked``) before those they are compared with."""
    for _, cell in itertools.groupby(pieces(batches), key=lambda p: p[0]):
        held, best = [], None
        for _, asked, ids, vectors, kind in cell:
            if asked:
                held.append((ids, vectors))
            elif held:
                best = best or Best(*(np.concatenate(c) for c in zip(*held, strict=True)), k)
                best.add(ids, vectors)
        if best is not None:
            yield best.rows(kind)
