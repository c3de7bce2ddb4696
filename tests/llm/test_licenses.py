"""License rules: base phrases against a plain scan, the whole result against its SQL, and what the rules say of samples."""

import random
import re

import duckdb
import pytest

from larkspur.llm import licenses as lic
from tests.llm.fixture import docs, none

SAMPLES = {
    "SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2",
    "spdx-license-identifier: (MIT)": "mit",
    "# SPDX-License-Identifier: CC-BY-NC-SA-4.0": "cc-by-nc,cc-by-nc-sa",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal": "mit",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that": "bsd",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived": "bsd-3-clause",
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.": "apache-2",
    "http://www.apache.org/licenses/LICENSE-2.0.html": "apache-2",
    "This work is licensed under the GNU General Public License, version 3.": "gpl-3",
    "GNU Lesser General Public License v2.1": "lgpl-2",
    "under the terms of the GNU Affero General Public License v3": "agpl-3",
    "https://creativecommons.org/licenses/by-sa/4.0/": "cc-by-sa",
    "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License": "cc-by-nc-nd",
    "dual use: New BSD or MIT license, or the Mozilla Public License 2.0": "bsd-3-clause,mit,mpl-2",
    "Released under the Boost Software License": "bsl-1",
    "Licensed under the Frobnicate License.": "other",
    "Mit der Lizenz, apache, boost, open, public, zero, the license of mit": "",
    "the gnu eats grass": "",
    "GPL gplv3 gpl-2.0": "gpl,gpl-2,gpl-3",
}


def base_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    found = []
    for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
        own = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(own)] == own]
    return len(words), found


def scanned(spark, texts):
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r.doc_id: r for r in lic.license_labels(table).collect()}


def from_sql(texts):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    cursor = con.execute(lic.license_sql())
    names = [d[0] for d in cursor.description]
    return {row[names.index("doc_id")]: dict(zip(names, row, strict=True)) for row in cursor.fetchall()}


def test_samples(spark):
    found = scanned(spark, list(SAMPLES))
    assert {t: found[i].labels for i, t in enumerate(SAMPLES)} == SAMPLES


@pytest.fixture(scope="module")
def mixed():
    rnd = random.Random(3)
    words = "under the mit license MIT apache License, version 2 2.0 v2 cc by nc CC-BY-NC sa bsd gnu general public gpl licensed released creative commons attribution spdx identifier é naïve 3 clause\x00 new zlib".split(" ")
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 120))) for _ in range(300)]
    parts = list(SAMPLES)
    texts += ["\n".join(rnd.choice(parts) for _ in range(6)) for _ in range(60)]
    return [*texts, "", " ", "cc by nc " * 3000, "cc " * 500, "a" * 100_000 + " under the MIT license", "under the mit license"]


def test_base_phrases_equal_a_plain_scan(spark, mixed):
    found = scanned(spark, [*mixed, None])
    for i, text in enumerate([*mixed, None]):
        n, places = base_places(text)
        starts, r = [p for p, _ in places], found[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_whole_result_equals_its_sql(spark, mixed):
    texts = [*mixed, *SAMPLES]
    want = from_sql(texts)
    for i, r in scanned(spark, texts).items():
        assert r.asDict() == want[i]


def test_a_rule_is_never_longer_than_a_place():
    assert all(len(re.sub(r"[()?:|]|\{[^}]*\}", " ", pattern).split()) <= 45 for _, _, _, _, pattern, *_ in lic.RULES)
    assert len({r[4] for r in lic.RULES}) > 300


def test_awkward_rows(spark):
    table = docs(spark)
    assert sorted(r.doc_id for r in lic.license_labels(table).collect()) == sorted(r.doc_id for r in table.collect())
    assert lic.license_labels(none(spark)).collect() == []
    clash = spark.createDataFrame([(None, "cc by nc", 1, 2, 3), (None, "cc by nc", 1, 2, 3)], "doc_id long, text string, row int, label int, start int")
    assert [tuple(r)[:4] for r in lic.license_labels(clash).collect()] == [(None, 3, 1, 0)] * 2


def test_main_path_is_native(spark):
    plan = lic.license_labels(docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
