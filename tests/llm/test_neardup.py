import random
import re

import numpy as np
import pytest

from larkspur.llm import neardup, queries

from .fixture import SCHEMA, docs, none, rows


def brute(pairs, percent):
    """pairs: (doc_id, text). Rows (doc_id, n_shingles, component_id, kept) by all pairs and union-find."""
    sets = {}
    for i, t in pairs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}) if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(sets, key=lambda i: len(sets[i]))
    for n, i in enumerate(order):
        for j in order[n + 1 :]:
            if 100 * len(sets[i]) < percent * len(sets[j]):
                break
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i, _ in pairs)


def groups():
    """Chains, stars and lone texts: copies with a few words replaced, around the threshold."""
    rnd, out = random.Random(8), []
    word = lambda: "w" + str(rnd.randint(0, 4000))
    for g in range(12):
        base = [word() for _ in range(rnd.randint(30, 220))]
        for _ in range(rnd.randint(1, 14)):
            text = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 40))):
                text[rnd.randrange(len(text))] = word()
            if g % 3 == 0:
                base = text
            out.append(" ".join(text))
    shared = [word() for _ in range(60)]
    out += [" ".join(shared + [word() for _ in range(15)]) for _ in range(40)]
    rnd.shuffle(out)
    return [(1000 + i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("percent", [80, 85])
def test_against_brute_force(spark, percent):
    pairs = [(r[0], r[1]) for r in rows()] + groups()
    df = spark.createDataFrame([(i, t, None, None, 1, "w", 1, "l", 1) for i, t in pairs], SCHEMA).repartition(4)
    got = sorted(map(tuple, neardup.near_duplicates(df, percent=percent).collect()))
    assert got == brute(pairs, percent)
    assert 20 < sum(not r[3] for r in got) < len(got) - 20


def test_edges(spark):
    assert neardup.near_duplicates(none(spark)).count() == 0
    lost = spark.createDataFrame([(None, "a b c d e f", "", "", 1, "", 1, "", 1), (None, "a b c d e f", "", "", 1, "", 1, "", 1), (4, None, None, None, None, None, None, None, None)], SCHEMA)
    assert sorted(map(tuple, neardup.near_duplicates(lost).collect()), key=str) == [(4, 0, 4, True), (None, 2, None, True), (None, 2, None, True)]


def test_stage_keeps_one_row_of_each_group(spark):
    out = neardup.without_near_duplicates(docs(spark))
    kept = {i for i, _, _, k in brute([(r[0], r[1]) for r in rows()], 80) if k}
    assert out.columns == docs(spark).columns and {r.doc_id for r in out.collect()} == kept


def test_components_of_long_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(159, 200), (7, 7)]
    got = {(r.src, r.dst) for r in neardup.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {(i, 0) for i in range(1, 41)} | {(i, 100) for i in [*range(101, 160), 200]}


def test_bands_and_signatures():
    for percent in (80, 85):
        bands, size = neardup.band_plan(percent)
        assert (1 - (percent / 100) ** size) ** bands <= neardup.MISS and bands * size <= neardup.MAX_MINIMA
    hasher, rng = neardup.MinHash(85), np.random.default_rng(0)
    for share in (0.5, 0.85, 0.95):
        a = np.unique(rng.integers(0, 2**63, 4000, dtype=np.int64).astype(np.uint64))
        keep = int(len(a) * 2 * share / (1 + share))
        b = np.unique(np.concatenate([a[:keep], rng.integers(0, 2**63, len(a) - keep, dtype=np.int64).astype(np.uint64)]))
        x, y = hasher.minima(a), hasher.minima(b)
        assert abs((x == y).mean() - share) < 0.11
        assert neardup.similar_signatures(hasher.signature(x), hasher.signature(y), 85) == (share > 0.6)


def test_the_table_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    pairs = [(r.doc_id, r.text) for r in queries.table(spark, sf, "documents").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op5_neardup(spark, sf).collect())) == brute(pairs, 85)


def test_of_several_texts_under_one_id_one_stands_for_it(spark):
    base = [f"w{k}" for k in range(60)]
    text = lambda n: " ".join(base[:-1] + [f"end{n}"])
    other = " ".join(f"other{k}" for k in range(40))
    given = [(1, text(1)), (2, text(2)), (2, other), (2, other), (3, other), (4, None), (4, text(4)), (5, "alone in the world"), (None, text(1))]
    got = neardup.near_duplicates(spark.createDataFrame(given, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(given)
    seq = {t: neardup.hashlib.blake2b(b" ".join(neardup.words_of(t)), digest_size=16).digest() for t in (text(2), other)}
    alike = seq[text(2)] < seq[other]  # else the other text stands for 2
    home = {1: 1, 2: 1 if alike else 2, 3: 3 if alike else 2, 4: 1, 5: 5, None: None}
    assert sorted({(r.doc_id, r.component_id) for r in got}, key=str) == sorted(home.items(), key=str)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
