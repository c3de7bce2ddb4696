"""Alignment of two tokenizers against a plain version that holds everything in dictionaries."""

import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from larkspur.llm import tokenalign as t
from larkspur.llm.bpe import byte_alphabet
from larkspur.llm.queries import BPE_VOCABULARY, PIECE_MODEL
from tests.llm.fixture import docs, none


def brute_force(rows):
    a, b = Tokenizer.from_file(BPE_VOCABULARY), sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    a.encode_special_tokens = True
    alphabet = byte_alphabet()
    found, counts = [], Counter()
    for doc_id, text in rows:
        ids_a = [(i, bytes(alphabet[c] for c in a.id_to_token(i))) for i in a.encode(" " + (text or ""), add_special_tokens=False).ids]
        ids_b = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text or "")]
        raw = (" " + (text or "")).encode()
        groups, part, end_a, end_b, at = [], ([], []), 0, 0, 0
        if text and b"".join(x for _, x in ids_a) == raw and b"".join(x for _, x in ids_b) == raw:
            left, right = list(ids_a), list(ids_b)
            while left or right:
                if end_a <= end_b:
                    i, x = left.pop(0)
                    part[0].append(i)
                    end_a += len(x)
                else:
                    i, x = right.pop(0)
                    part[1].append(i)
                    end_b += len(x)
                if end_a == end_b > at:
                    groups.append(part)
                    part, at = ([], []), end_a
        counts.update((g[0][-1], g[1][-1]) for g in groups)
        found.append((doc_id, groups))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for doc_id, groups in found:
        links = [(g[0][-1], g[1][-1]) for g in groups]
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((doc_id, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def aligned(spark, rows, parts=3):
    out = t.aligned(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), BPE_VOCABULARY, PIECE_MODEL)
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_equals_dictionaries_on_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in docs(spark).collect()]
    rows += [(None, "x y"), (None, None), (900, "▁already a mark"), (901, "<s> </s> <unk> <0x0A> <|endoftext|>"), (902, "日本語の文。ไทย \U0001f600́"), (903, "a\x00b\r\n\tc  d   "), (904, "  lead")]
    assert aligned(spark, rows) == brute_force(rows)


def test_equals_dictionaries_on_a_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert aligned(spark, rows) == brute_force(rows)


def test_one_pair_in_a_third_of_all_rows_and_folds_within_tasks(spark, monkeypatch):
    rnd = random.Random(4)
    rows = [(i, "," if i % 3 else " ".join(rnd.choice(["alpha", "beta", "Zürich", "--", "x1"]) for _ in range(20))) for i in range(900)]
    assert aligned(spark, rows) == brute_force(rows)


def test_folding_and_rows_of_counts(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(t, "FOLD_AT", 50)
    monkeypatch.setattr(t, "ROW_PAIRS", 7)
    rnd = np.random.default_rng(1)
    batches, want = [], Counter()
    for _ in range(20):
        pairs, times = rnd.integers(0, 400, 30).astype(np.uint32) << 12, rnd.integers(1, 9, 30).astype(np.int32)
        want.update({int(p): 0 for p in pairs})
        for p, n in zip(pairs, times, strict=True):
            want[int(p)] += int(n)
        batches.append(pa.record_batch({"pairs": [pairs.tobytes()], "times": [times.tobytes()]}))
    partial = sorted((r for b in t.within_tasks(iter(batches)) for r in b.to_pylist()), key=lambda r: r["stripe"])
    got = Counter()
    for b in t.whole_stripes(iter([pa.RecordBatch.from_pylist(partial, schema=t.COUNTS)])):
        for r in b.to_pylist():
            for p, n in zip(np.frombuffer(r["pairs"], np.uint32), np.frombuffer(r["counts"], np.int64), strict=True):
                assert int(p) not in got
                got[int(p)] = int(n)
    assert got == want


@pytest.mark.parametrize("text", ["a" * 60_000, "!" * 60_000, " " * 60_000 + "x", "9" * 60_000, "ab1 " * 20_000, "é" * 30_000])
def test_long_words_are_merged_as_the_library_merges(text):
    a = Tokenizer.from_file(BPE_VOCABULARY)
    assert t.aligner(BPE_VOCABULARY, PIECE_MODEL).a.encode([text])[0] == a.encode(" " + text, add_special_tokens=False).ids


def test_an_empty_table(spark):
    assert t.aligned(none(spark), BPE_VOCABULARY, PIECE_MODEL).collect() == []
