"""The compaction plan against a plain fold over the files, on chains that cross many nodes of several levels."""

import hashlib
import random
import zlib

import pytest

from larkspur.llm import compaction as c
from tests.llm.fixture import SCHEMA, docs, none


def brute_force(rows):
    files = {}
    for doc_id, text, source in rows:
        if doc_id is None:
            continue
        h, block = zlib.crc32(str(doc_id).encode()), doc_id // 2000
        slot = min(h % 8, h // 8 % 8)
        files.setdefault((source or "", block, slot), []).append((doc_id, text or "", h // 64 % 100 < 9 * ((slot + block) % 8)))
    size = {f: sum(len(t.encode()) for _, t, _ in held) for f, held in files.items()}
    live = {f: sum(len(t.encode()) for _, t, dead in held if not dead) for f, held in files.items()}
    dirty = {f for f, held in files.items() if 100 * sum(dead for *_, dead in held) >= 50 * len(held)}
    groups = []
    for f in sorted(files):
        if f not in dirty and 4 * size[f] >= 3 * 131072:
            continue
        if groups and groups[-1][0][0] == f[0] and sum(live[x] for x in groups[-1]) + live[f] <= 131072:
            groups[-1].append(f)
        else:
            groups.append([f])
    queue = sorted((g for g in groups if len(g) > 1 or g[0] in dirty), key=lambda g: (-len(g), sum(size[f] for f in g), g[0]))
    whole, upto, units = sum(size[f] for g in queue for f in g), 0, []
    for place, g in enumerate(queue):
        upto += sum(size[f] for f in g)
        if 100 * upto > 30 * whole:
            break
        units.append((g, place // 4))
    moved = {f for g, _ in units for f in g}
    units += [([f], None) for f in files if f not in moved]
    out = set()
    for g, wave in units:
        held = sorted((i, t) for f in g for i, t, dead in files[f] if not dead)
        cost = None if wave is None else sum(size[f] + live[f] for f in g) + 4096 * len(g)
        out.add((*g[0], len(g), len(held), sum(size[f] for f in g), cost, wave, hashlib.sha256("".join(f"{i}:{t}\n" for i, t in held).encode()).hexdigest(), sum(live[f] for f in g)))
    return out


def planned(spark, rows):
    out = [tuple(r) for r in c.compaction_plan(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()]
    assert len(out) == len(set(out))
    return set(out)


def chained(seed, sizes, blocks=90):
    """Rows of a hot and two small sources over many blocks, with ids below zero and gaps."""
    rnd = random.Random(seed)
    ids = rnd.sample(range(-20_000, -20_000 + 2000 * blocks), 1500)
    return [(i, "é" * (rnd.choice(sizes) // 2), rnd.choice(["hot"] * 8 + ["a", None])) for i in ids]


@pytest.mark.parametrize("sizes", [(0, 2, 60_000, 90_000), (140_000, 0, 0, 2), (2, 4, 6), (30_000, 131_072, 131_074, 40_000)], ids=str)
def test_equals_a_fold_over_the_files(spark, monkeypatch, sizes):
    monkeypatch.setattr(c, "FILE_BLOCKS", 2)
    monkeypatch.setattr(c, "FAN", 4)
    rows = chained(len(sizes), sizes, blocks=60)
    assert planned(spark, rows) == brute_force(rows)


def test_nodes_of_the_usual_size(spark):
    rows = chained(9, (0, 2, 50_000, 200_000), blocks=700)
    assert planned(spark, rows) == brute_force(rows)


def test_awkward_rows(spark):
    rows = [(r[0], r[1], r[3]) for r in docs(spark).collect()] + [(None, "x", "s"), (None, None, None), (2**62, "far", "s1"), (-5, "z" * 400_000, "s1")]
    assert planned(spark, rows) == brute_force(rows)


def test_an_empty_table_and_clashing_columns(spark):
    assert c.compaction_plan(none(spark)).collect() == []
    clash = spark.createDataFrame([(1, "t", "s", 1, 2, 3), (2, None, None, 1, 2, 3)], "doc_id long, text string, source string, block int, slot int, node int")
    assert len(c.compaction_plan(clash).collect()) == 2
    assert SCHEMA.startswith("doc_id")
