import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from larkspur.llm import pii

from .fixture import SCHEMA, docs, none, rows

TEXTS = [
    "a@b.co@d.ef x.y+z%1@q-r.s.t. no@dot @x.y me@-.- ü@x.y",
    "ip 1.2.3.4 256.1.1.1 1.2.3 01.002.003.255 1.2.3.4.5 9999999.1.1.1 255.255.255.255",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112 x 378282246310005 12",
    "tel +1 (988) 555-2485 and +12 and +1 (269) 555-3296 4524132264652876 and +49 30 1234567- end",
    "ssn 123-45-6789, call 555-867-5309 or (212) 555-0199.",
    "+" + "5" * 14 + " 4 " * 40 + "1 2 3 4 5 6 7 8 9",
    "é" * 5 + " mail élan@ex.org",
    "a" * 50_000 + "@", "1" * 50_000, "1 " * 20_000, "+ " * 1000 + "@" * 1000, "the plain old prose of a clean text.", "",
]


def plain_base(text):
    def luhn(d):
        return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m[0])
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    )
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted((m.start(), i, k, m.end()) for i, (k, p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m))]


def test_pattern_spans_against_the_plain_patterns():
    rnd = random.Random(4)
    some = [t for t in TEXTS if len(t) < 9000] + ["".join(rnd.choice("ab1.2@+- ()9\n") for _ in range(60)) for _ in range(3000)]
    for t in some:
        assert pii.listed(pii.base_spans(t)).split(",") == (plain_base(t) or [""])


def test_rows(spark):
    texts = [*TEXTS, None, *(r[1] for r in rows())]
    df = spark.createDataFrame([(i, t, None, None, 1, "w", 1, "l", 1) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in pii.personal_data(df).collect()}
    for i, t in enumerate(texts):
        if len(t or "") < 9000:
            want = plain_base(t or "")
            assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
            assert [x for x in got[i].spans.split(",") if x and not x.startswith("crf")] == want
            assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(x.startswith(k) for x in want) for k in pii.BASE]
    assert "crf_phone:15:32" in got[3].spans or "crf_phone" in got[3].spans
    assert "crf_id:4:15" in got[4].spans and "crf_phone" in got[4].spans
    assert got[11].spans == "" == got[len(TEXTS)].spans
    assert pii.personal_data(none(spark)).count() == 0 and pii.personal_data(docs(spark)).count() == len(rows())


def test_field_learns_its_table():
    field, right, total = pii.trained(), 0, 0
    for tokens, labels in pii.labelled_table():
        starts = pii.starts_of(tokens)
        for a, b in pii.runs_of(tokens, starts):
            right += [pii.LABELS[x] for x in field.decode([field.scores(tokens, a, b, starts)])[0]] == labels[a:b]
            total += 1
    assert right / total > 0.97


@pytest.mark.parametrize("t", [1, 2, 4])
def test_viterbi_against_all_paths(t):
    field, rng = pii.trained(), np.random.default_rng(t)
    score = rng.normal(size=(t, len(pii.LABELS))) * 3
    best = max(itertools.product(range(len(pii.LABELS)), repeat=t), key=lambda p: field.step[0, p[0]] + sum(score[i, x] for i, x in enumerate(p)) + sum(field.step[a, b] for a, b in zip(p, p[1:], strict=False)) + field.step[p[-1], 0])
    assert list(field.decode([score, score[:1]])[0]) == list(best)
