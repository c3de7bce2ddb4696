"""Bounds of the alike texts: nothing at or just over the threshold is lost, and pairs that cannot be alike are not compared."""

import random

from larkspur.operators import curation


def test_same_as_all_pairs(spark):
    rnd = random.Random(5)
    base = [[f"w{rnd.randrange(300)}" for _ in range(rnd.choice((1, 2, 7, 20, 40, 80)))] for _ in range(60)]
    texts = base + [[w for w in t if rnd.random() > 0.1] + [f"w{rnd.randrange(300)}" for _ in range(rnd.randrange(4))] for t in base]
    sets = {i: frozenset(t) for i, t in enumerate(texts) if t}
    reps = {}
    for i, s in sets.items():
        reps.setdefault(s, i)
    want = {(i, reps[s]) for i, t in sets.items() for s in reps if 100 * len(t & s) >= 85 * len(t | s)}
    got = curation.alike_texts(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id long, t string"), "id", "t", 85)
    assert {(r[0], r[1]) for r in got.collect()} == want and len(want) > len(sets)
