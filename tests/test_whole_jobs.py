"""Queries that answer for whole tables, where an older query of fixed SQL covers a part only."""

import numpy as np

from larkspur.operators import joins
from larkspur.plans import registry
from larkspur.plans.common import table

SF = "/root/testdata/sf0.001"


def test_every_vector_has_its_neighbours(spark):
    rows = table(spark, SF, "embeddings")
    got = registry.queries()["cosine_topk_all"](spark, SF)
    assert {r.q for r in got.select("q").distinct().collect()} == {r.vec_id for r in rows.select("vec_id").collect()}


def test_blocks_do_not_change_the_neighbours(spark):
    rng = np.random.default_rng(5)
    v = rng.integers(-2, 3, size=(60, 4)).astype(float)
    v[:, 0] += 3.5
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<float>")
    unit = v / np.sqrt((v * v).sum(1))[:, None]
    whole = [tuple(r) for r in joins.nearest(df, "id", "v", 3).select("id", "rn", "near_id").orderBy("id", "rn").collect()]
    assert whole == [tuple(r) for r in joins.nearest(df, "id", "v", 3, block=7).select("id", "rn", "near_id").orderBy("id", "rn").collect()]
    for i, rn, near in whole:
        best = np.sort(np.delete(unit @ unit[i], i))[::-1]
        assert near != i and abs(unit[near] @ unit[i] - best[rn - 1]) < 1e-9


def test_case_variants_are_found_in_all_nations(spark):
    got = registry.queries()["case_variants_all"](spark, SF)
    assert {r.c_nationkey for r in got.collect()} == {r.c_nationkey for r in table(spark, SF, "customer").select("c_nationkey").distinct().collect()}


def test_every_repeated_document_reaches_the_first_of_its_text(spark):
    first, want = {}, set()
    for r in table(spark, SF, "documents").where("text IS NOT NULL").orderBy("doc_id").collect():
        if first.setdefault(r.text, r.doc_id) != r.doc_id:
            want.add((r.doc_id, first[r.text]))
    assert want and want == {tuple(r) for r in registry.queries()["canonical_chase_documents"](spark, SF).select("node", "target").collect()}
