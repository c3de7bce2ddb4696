import random
import zlib
from collections import Counter

from larkspur.llm import sharding

from .fixture import docs, none, rows


def test_tree_finds_the_tightest_bin():
    rnd, tree, keys = random.Random(1), sharding.CapacityTree(), []
    for i in range(2000):
        if keys and rnd.random() < 0.4:
            tree.remove(keys.pop(rnd.randrange(len(keys))))
        else:
            keys.append((rnd.randint(0, 50), i))
            tree.add(keys[-1])
        want = rnd.randint(0, 60)
        assert tree.tightest(want) == min((k for k in keys if k[0] >= want), default=None)
        assert tree._h(tree.root) <= 2 * (len(keys) + 2).bit_length()


def plain_best_fit(sizes, cap):
    """One item at a time, by a scan of all bins: the sorted sizes that each bin holds."""
    bins = []
    for s in sorted(sizes, reverse=True):
        fit = min(((r, b) for b, (r, _) in enumerate(bins) if r >= s), default=None)
        if fit is None:
            bins.append([cap - s, [s]])
        else:
            bins[fit[1]][0] -= s
            bins[fit[1]][1].append(s)
    return [held for _, held in bins]


def held_by(placed, bins):
    out = [[] for _ in range(bins)]
    for size, parts in placed.items():
        for b, k in parts:
            out[b] += [size] * k
    return [sorted(x, reverse=True) for x in out]


def test_best_fit_decreasing_by_classes_equals_one_by_one():
    rnd = random.Random(2)
    for n, most in [(60, 70)] * 40 + [(3000, 25)] * 5:
        sizes = [rnd.randint(1, most) for _ in range(n)]
        want = plain_best_fit(sizes, 100)
        placed = sharding.best_fit_decreasing(Counter(sizes).items(), 100)
        assert held_by(placed, len(want)) == want
        assert sharding.best_fit_decreasing(Counter(sizes).items(), 100, len(want)) == placed
        assert sharding.best_fit_decreasing(Counter(sizes).items(), 100, len(want) - 1) is None


def test_many_small_groups_are_packed_by_their_own_size(spark, monkeypatch):
    """20,000 groups of 1 to 40 bytes and some larger ones: each shard holds what plain best fit puts there."""
    monkeypatch.setattr(sharding, "RANKED", 100)
    rnd = random.Random(4)
    texts = [f"{i:05d}" + "x" * rnd.randint(0, 35) for i in range(20_000)] + ["y" * rnd.randint(500, 9000) for _ in range(20)] + ["twin"] * 3000
    got = sharding.shard_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5), 8).collect()
    groups = {t: k * (len(t) + 1) for t, k in Counter(texts).items()}
    home = {}
    for r in got:
        assert home.setdefault(texts[r.doc_id], r.shard) == r.shard
    assert len(got) == len(texts) and set(home) == set(groups)
    held = [sorted((groups[t] for t, s in home.items() if s == k), reverse=True) for k in range(8)]
    capacity = max(map(sum, held))
    assert sorted(plain_best_fit(list(groups.values()), capacity)) == sorted(held)
    assert capacity - min(map(sum, held)) <= 40 + capacity // 1000


def test_documents(spark):
    got = sharding.shard_documents(docs(spark), 8).collect()
    by = {}
    for i, t, *_ in rows():
        by[i] = (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows())
    assert all((r["size"], r.text_crc32) == by[r.doc_id] for r in got)
    text = {i: t or "" for i, t, *_ in rows()}
    home = {}
    for r in got:
        assert home.setdefault(text[r.doc_id], r.shard) == r.shard
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard_documents(none(spark), 8).count() == 0


def test_sizes_are_near_equal_and_a_huge_group_stands_alone():
    rnd = random.Random(5)
    classes = Counter(rnd.randint(1, 4000) for _ in range(3000))
    load = [sum(x) for x in held_by(sharding.balanced_packing(classes.items(), 8), 8)]
    assert sum(load) == sum(s * n for s, n in classes.items()) and max(load) - min(load) <= 0.002 * sum(load)
    held = held_by(sharding.balanced_packing([(10**9, 1), *classes.items()], 8), 8)
    assert [10**9] in held and all(held)
    assert sorted(map(sum, held_by(sharding.balanced_packing([(10**9, 3), (5, 2)], 8), 8)))[-3:] == [10**9] * 3
    assert sharding.balanced_packing([], 8) == {}
