import hashlib

import pytest

tokenizers = pytest.importorskip("tokenizers")
import corpus_pipeline  # noqa: E402
from larkspur.llm import langid  # noqa: E402
from larkspur.llm.queries import BPE_VOCABULARY, table  # noqa: E402

from . import test_linededup, test_neardup  # noqa: E402
from .test_decontam import best_overlap, words  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "near_dedup", "decontamination", "encoding"]

    def step(name, docs):
        out = stages[name](spark, docs, SF)
        assert out.columns == columns
        return spark.createDataFrame(out.collect(), out.schema)

    def texts(d):
        return sorted((r.doc_id, r.text) for r in d.collect())

    known = step("language_id", docs)
    assert texts(known) == [x for x in texts(docs) if langid.features(x[1]) is not None]
    lined = step("line_dedup", known)
    assert texts(lined) == [(i, t) for i, _, _, t in test_linededup.brute([(i, t) for i, t in texts(known)])]
    single = step("near_dedup", lined)
    kept = {i for i, _, _, k in test_neardup.brute(texts(lined), 80) if k}
    assert texts(single) == [x for x in texts(lined) if x[0] in kept]
    clean = step("decontamination", single)
    items = [words(r.text) for r in table(spark, SF, "benchmark").collect()]
    grams = {tuple(x[i : i + 3]) for x in items for i in range(len(x) - 2)}
    left = {i for i, _ in texts(clean)}
    for i, t in texts(single):
        w = words(t)
        near = any(tuple(w[k : k + 3]) in grams for k in range(len(w) - 2))
        leaks = near and any(" " + " ".join(x) + " " in " " + " ".join(w) + " " for x in items)
        assert not (leaks and i in left)
        if i not in left:
            assert max(best_overlap(w, x) for x in items) >= 0.8
    done = stages["encoding"](spark, clean, SF).collect()
    t = tokenizers.Tokenizer.from_file(BPE_VOCABULARY)
    want = {i: t.encode(x, add_special_tokens=False).ids for i, x in texts(clean)}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in done} == {i: (len(e), hashlib.sha256(",".join(map(str, e)).encode()).hexdigest(), hashlib.sha256(t.decode(e, skip_special_tokens=False).encode()).hexdigest()) for i, e in want.items()}
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, done))


def test_empty_documents(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
