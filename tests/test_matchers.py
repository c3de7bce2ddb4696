"""The label automaton against plain scans and a large vocabulary; registry names by prefix against all pairs."""

import random
import time

import pytest

from larkspur.operators import automaton, registry


def test_automaton_equals_a_plain_scan():
    rnd = random.Random(2)
    for _ in range(300):
        words = "abcd"[: rnd.randint(1, 4)]
        terms = sorted({tuple(rnd.choice(words) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(1, 12))})
        found = automaton.Automaton(terms)
        for _ in range(5):
            text = [rnd.choice(words + "x") for _ in range(rnd.randint(0, 30))]
            want = {n for n, t in enumerate(terms) if any(tuple(text[i : i + len(t)]) == t for i in range(len(text)))}
            assert found.find(text) == want
    assert automaton.Automaton([]).find(["a"]) == set()


def test_a_hundred_thousand_labels_in_one_pass():
    rnd = random.Random(5)
    stock = [f"w{i}" for i in range(20_000)]
    terms = sorted({tuple(rnd.choice(stock) for _ in range(rnd.randint(1, 5))) for _ in range(100_000)})
    made = time.time()
    found = automaton.Automaton(terms)
    assert time.time() - made < 30
    text = []
    planted = set()
    for _ in range(2000):
        n = rnd.randrange(len(terms))
        planted.add(n)
        text += [*terms[n], "unknown", rnd.choice(stock)]
    ends = {t: i for i, t in enumerate(terms)}
    want = {ends[tuple(text[i : i + n])] for i in range(len(text)) for n in range(1, 6) if tuple(text[i : i + n]) in ends}
    started = time.time()
    assert found.find(text) == want >= planted and time.time() - started < 2


VOCABULARY = [
    ("Data analysis", "analysis", "en", True), ("analyse de données", "analysis", "fr", False), ("C++ developer", "c++", "en", True), ("Kafka", "kafka", "en", True), ("stream", "kafka", "en", False),
    ("Kafka streams", "kafka", "en", False), ("art", "art", "en", True), ("Kochen", "cooking", "de", True), ("cooking", "cooking", None, True), (None, "none", "en", True), ("data", "unwanted", "en", True), ("x" * 61, "long", "en", True),
]
TEXTS = [
    (1, "Kafka and data  ANALYSIS, part-time art.", "en"), (2, "Kafka, analyse de données; kochen", "fr"), (3, "kochen mit kafka streams", "de"), (4, "c++ developers; C++ developer!", None), (5, "", "en"), (6, None, "en"),
    (7, "cooking stream data", "en"), (8, "kafkastreams kafka-streams", "de"), (1, "a second row of one id: Kafka", "en"), (9, "kafka " * 20_000, "en"),
]
NAMES = [(1, ["analysis", "kafka"]), (1, ["kafka"]), (2, ["analysis"]), (3, ["cooking", "kafka"]), (4, ["c++"]), (8, ["kafka"]), (9, ["kafka"])]


@pytest.mark.parametrize("most_bytes", [automaton.AUTOMATON_BYTES, 0], ids=["automaton", "join"])
def test_guards_boundaries_and_languages(spark, monkeypatch, most_bytes):
    monkeypatch.setattr(automaton, "AUTOMATON_BYTES", most_bytes)
    vocabulary = spark.createDataFrame(VOCABULARY, "label string, name string, lang string, preferred boolean")
    texts = spark.createDataFrame(TEXTS, "id long, words string, lang string").repartition(3)
    found = automaton.label_names(texts, "id", "words", "lang", vocabulary, ["data"])
    assert sorted((r.id, r.names) for r in found.collect()) == NAMES
    one = automaton.label_names(texts, "id", "words", "lang", vocabulary, ["data"], most=1)
    assert sorted((r.id, r.names) for r in one.collect()) == [(i, n[:1]) for i, n in NAMES]


def test_no_labels_and_no_texts(spark):
    vocabulary = spark.createDataFrame([], "label string, name string, lang string, preferred boolean")
    texts = spark.createDataFrame(TEXTS, "id long, words string, lang string")
    assert automaton.label_names(texts, "id", "words", "lang", vocabulary).collect() == []
    full = spark.createDataFrame(VOCABULARY, vocabulary.schema)
    assert automaton.label_names(texts.limit(0), "id", "words", "lang", full).collect() == []


def test_registry_names(spark):
    own = [(1, "Qantas"), (2, "Westpac Banking"), (3, "ACME"), (4, "Acme Tools of Rome Ltd"), (5, "abc"), (6, None), (7, "Qantas GmbH"), (8, "Nobody here"), (1, "QANTAS")]
    entries = [(1, "PAC Constructions", 1), (2, "Qantas Limited", 2), (3, "Qantas Airways", 1), (4, "The Trustee for Westpac Banking Fund", 1), (5, "Westpac Banking Corporation", 3), (13, "Acme of Perth", 1), (6, "Westpac Banking Group Two", 1), (7, "Acme Tools", 2), (8, "Acme", 1), (9, "Acmeville", 0), (10, None, 0), (11, "abc", 0), (12, "Acme Tools", 1)]
    found = registry.best_entries(spark.createDataFrame(own, "id long, name string"), "id", "name", spark.createDataFrame(entries, "entry long, title string, kind int"), "entry", "title", "kind")
    assert sorted(tuple(r) for r in found.collect()) == [
        (1, "same", 2, "Qantas Limited"), (1, "same", 2, "Qantas Limited"), (2, "same", 5, "Westpac Banking Corporation"), (3, "same", 8, "Acme"), (4, "within", 12, "Acme Tools"), (7, "same", 2, "Qantas Limited"),
    ]


def test_registry_equals_all_pairs_with_one_hot_beginning(spark):
    rnd = random.Random(8)
    words = ["north", "south", "steel", "works", "trade", "of", "x"]
    name = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 4)))
    own = [(i, "north steel" if i % 3 == 0 else name()) for i in range(200)]
    entries = [(i, f"north steel {i} works" if i % 3 == 0 else name(), rnd.randint(0, 2)) for i in range(400)]
    got = {r.id: r.entry for r in registry.best_entries(spark.createDataFrame(own, "id long, name string"), "id", "name", spark.createDataFrame(entries, "entry long, title string, kind int"), "entry", "title", "kind").collect()}
    for i, core in own:
        best = []
        for entry, key, kind in entries:
            if len(core) >= 4 and len(key) >= 4 and (key == core or key.startswith(core + " ") or core.startswith(key + " ")):
                tier = 0 if key == core else 1 if key.startswith(core) else 2
                best.append((tier, -len(key) if tier == 2 else 0, kind, len(key), key, entry))
        assert got.get(i) == (min(best)[-1] if best else None)
