import hashlib
import random

import pytest

tokenizers = pytest.importorskip("tokenizers")
from larkspur.llm import bpe  # noqa: E402
from larkspur.llm.queries import BPE_VOCABULARY  # noqa: E402

from .fixture import docs, none, rows  # noqa: E402


def test_digests_match_the_library(spark):
    t = tokenizers.Tokenizer.from_file(BPE_VOCABULARY)
    want = sorted((i, len(e), hashlib.sha256(",".join(map(str, e)).encode()).hexdigest(), hashlib.sha256(t.decode(e, skip_special_tokens=False).encode()).hexdigest()) for i, x, *_ in rows() for e in [t.encode(x or "", add_special_tokens=False).ids])
    got = sorted(map(tuple, bpe.digest_documents(docs(spark), BPE_VOCABULARY).collect()))
    assert got == want
    assert bpe.digest_documents(none(spark), BPE_VOCABULARY).count() == 0


def test_round_trip_and_ids(spark):
    t = tokenizers.Tokenizer.from_file(BPE_VOCABULARY)
    by = {i: (x or "") for i, x, *_ in rows()}
    for r in bpe.encode_documents(docs(spark), BPE_VOCABULARY).collect():
        assert r.decoded == by[r.doc_id]
        assert r.ids == t.encode(by[r.doc_id], add_special_tokens=False).ids


def test_long_and_short_merges_agree():
    v = bpe.Vocabulary(BPE_VOCABULARY)
    rnd = random.Random(3)
    for n in (1, 2, 3, 17, 255, 600):
        for alphabet in (b"ab", b"abcdefghij the", bytes(range(256))):
            w = bytes(rnd.choice(alphabet) for _ in range(n))
            assert bpe.merge_short(w, v) == bpe.merge_long(w, v)
            assert b"".join(v.bytes[i] for i in bpe.merge_long(w, v)) == w
    assert b"".join(v.bytes[i] for i in bpe.merge_long(b"a" * 100_000, v)) == b"a" * 100_000


def test_a_full_cache_changes_nothing(monkeypatch):
    v = bpe.Vocabulary(BPE_VOCABULARY)
    whole, text = bpe.Encoder(v), " ".join(rows()[0][1].split() * 3)
    monkeypatch.setattr(bpe, "CACHE_BYTES", 700)
    small = bpe.Encoder(v)
    assert [small.encode(r[1] or "") for r in rows()] == [whole.encode(r[1] or "") for r in rows()]
    assert len(small.cache) <= 3 and len(small.old) <= 3 and small.encode(text) == whole.encode(text)
