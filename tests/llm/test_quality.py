import re
from collections import Counter, defaultdict

from larkspur.llm import quality, queries

from ..oracle import differences
from .fixture import SCHEMA, none, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, min_docs=quality.MIN_DOCS, max_share=quality.MAX_SHARE, max_docs=quality.MAX_DOCS, min_kept=quality.MIN_KEPT, min_words=quality.MIN_WORDS):
    lines = lambda t: [x for x in (t or "").split("\n") if WORD.search(x)]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    hosts, held = defaultdict(set), defaultdict(set)
    for r in rows:
        doc = ("id", r[0]) if r[0] is not None else ("text", r[1] or "")
        hosts[r[3]].add(doc)
        for x in lines(r[1]):
            held[r[3], key(x)].add(doc)
    out = []
    for r in rows:
        t = r[1] or ""
        w = WORD.findall(t)
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(tri)
        covered = {j for i, x in enumerate(tri) if n[x] > 1 for j in (i, i + 1, i + 2)}
        ls = lines(t)
        often = lambda n, host: n >= min_docs and (n > max_share * len(hosts[host]) or n >= max_docs)
        lost = sum(len(WORD.findall(x)) for x in ls if often(len(held[r[3], key(x)]), r[3]))
        bad = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        kept = not bad and len(w) - lost >= min_kept * len(w) and len(w) - lost >= min_words
        out.append((r[0], len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(ls) - len(set(ls)), len(covered), bad, kept, lost))
    return sorted(out, key=lambda x: (x[0] is None, x[1:] if x[0] is None else x))


def run(spark, rows, **limits):
    got = quality.quality_rules(spark.createDataFrame(rows, SCHEMA).repartition(3), **limits).collect()
    return sorted(map(tuple, got), key=lambda x: (x[0] is None, x[1:] if x[0] is None else x))


def test_against_brute_force(spark, monkeypatch):
    for limits in ({}, {"min_docs": 3, "max_share": 0.05, "min_kept": 0.95}, {"min_docs": 3, "max_share": 1.0, "max_docs": 12, "min_words": 60}):
        monkeypatch.setattr(quality, "BROADCAST_ROWS", quality.BROADCAST_ROWS if limits else -1)
        assert run(spark, rows(), **limits) == brute(rows(), **limits)
    got = run(spark, rows(), min_docs=3, max_share=0.05, min_kept=0.95)
    assert any(r[5] for r in got) and any(r[8] for r in got) and any(not r[6] and not r[7] for r in got)
    assert quality.quality_rules(none(spark)).count() == 0


def test_repeated_rows_are_one_document_and_a_hot_host_has_an_absolute_limit(spark):
    body = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    row = lambda i, t, host: (i, t, "en", host, 1, "w", 1, "l", 1)
    footer = "read more about our news and offers on the front page"
    made = [row(1, f"{footer}\n{body(1, 60)}", "small")] * 30  # one document, thirty rows
    made += [row(None, f"{footer}\n{body(2, 60)}", "none")] * 15 + [row(None, f"{footer}\n{body(i, 60)}", "none") for i in range(3, 8)]
    # a host of 3000 documents: 25 hold the footer, under 1 % and over the absolute limit of 20
    made += [row(1000 + i, f"{footer}\n{body(i, 45)}" if i < 25 else body(i, 55), "hot") for i in range(3000)]
    got = run(spark, made, max_docs=20)
    assert got == brute(made, max_docs=20)
    by = {r[0]: r for r in got if r[0] is not None}
    assert by[1][8] == 0 and by[1][7] and all(r[8] == 0 for r in got if r[0] is None)
    assert by[1000][8] == 11 and not by[1000][6] and not by[1000][7] and by[1025][7]
    assert run(spark, made, max_docs=26)[0] is not None and all(r[7] for r in run(spark, made, max_docs=26) if r[0] == 1000)


def test_the_tables_lose_depleted_documents(spark):
    """At sf0.1 the SQL's rows, some of them rejected for depletion alone."""
    sf = "/root/testdata/sf0.1"
    assert differences(spark, sf, queries.op8_quality, queries.OP8_SQL) is None
    assert queries.op8_quality(spark, sf).where("not kept and not base_failed").count() > 0
