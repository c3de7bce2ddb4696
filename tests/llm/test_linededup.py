import re
from collections import defaultdict

import numpy as np
import pytest

from larkspur.llm import linededup

from .fixture import SCHEMA, docs, none, rows


def brute(rows, min_docs=3):
    def key(x):
        x = re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x)
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)

    held = defaultdict(set)
    for r in rows:
        for x in (r[1] or "").split("\n"):
            if len(key(x)) >= 20:
                held[key(x)].add(r[0])
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        stay = [x for x in lines if len(held.get(key(x), ())) < min_docs or max(held[key(x)]) == r[0]]
        out.append((r[0], len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out)


@pytest.mark.parametrize("most_keys", [linededup.MAX_KEYS, -1])
def test_against_brute_force(spark, monkeypatch, most_keys):
    monkeypatch.setattr(linededup, "MAX_KEYS", most_keys)
    for given in (rows(), [(i, t, *r[2:]) for i, r in enumerate(rows()) for t in [r[1]]] + [(90 + i, "The very same line of text, repeated.\n" + str(i) * i, "", "", 1, "", 1, "", 1) for i in range(9)]):
        df = spark.createDataFrame(given, SCHEMA).repartition(4)
        got = sorted((r.row.doc_id, r.n_lines, r.n_dropped, r.kept) for r in linededup.dedup_lines(df).collect())
        assert got == brute(given)
    assert sum(r[2] for r in got) > 8
    assert linededup.dedup_lines(none(spark)).count() == 0


def test_ids_of_any_kind_and_rows_without_one(spark):
    line = "a line that many documents hold"
    given = [(i, f"{line}\nown {i}") for i in ("a", "b", "c", None, None)]
    for kind, name in (("string", str), ("long", {"a": 1, "b": 2, "c": 3}.get)):
        df = spark.createDataFrame([(None if i is None else name(i), t) for i, t in given], f"doc_id {kind}, text string")
        got = sorted(((r.row.doc_id, r.n_dropped) for r in linededup.dedup_lines(df).collect()), key=str)
        assert got == sorted([(name("a"), 1), (name("b"), 1), (name("c"), 0), (None, 1), (None, 1)], key=str)


def test_stage_keeps_rows_and_columns(spark):
    out = linededup.without_repeated_lines(docs(spark))
    assert out.columns == docs(spark).columns
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(i, t) for i, _, _, t in brute(rows())]


def test_filters_never_miss_a_repeat_whatever_the_split():
    rng = np.random.default_rng(3)
    some = rng.integers(0, 2**63, 4000, dtype=np.int64).astype(np.uint64)
    stream = np.concatenate([some, some[:500]])
    rng.shuffle(stream)
    parts = []
    for piece in np.array_split(stream, 7):
        f = linededup.Filters(2)
        for step in np.array_split(piece, 5):
            f.add(step)
        parts.append({i: (linededup.unpack(a), linededup.unpack(b)) for i, a, b in f.parts()})
    size = linededup.SEGMENT_BITS // 8
    once, twice = np.zeros(2 * size, np.uint8), np.zeros(2 * size, np.uint8)
    for p in parts:
        for i, (a, b) in p.items():
            s = slice(i * size, (i + 1) * size)
            twice[s] |= b | (once[s] & a)
            once[s] |= a
    hit = linededup.held(twice, linededup.places(some, 2))
    assert hit[:500].all() and hit[500:].mean() < 0.2


def test_segments_pack_both_ways():
    for fill in (0, 5, 3000, 60_000):
        bits = np.zeros(linededup.SEGMENT_BITS, np.uint8)
        bits[np.random.default_rng(fill).permutation(len(bits))[:fill]] = 1
        packed = np.packbits(bits, bitorder="little")
        assert (linededup.unpack(linededup.pack(packed)) == packed).all()
