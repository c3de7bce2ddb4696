import pytest

from larkspur.llm import pii

CASES = [
    ("my iban GB29 NWBK 6016 1331 9268 19 is here", "crf_id", "GB29 NWBK 6016 1331 9268 19"),
    ("account iban NL91 ABNA 0417 1643 00 today", "crf_id", "NL91 ABNA 0417 1643 00"),
    ("my name is Anna Keller and more", "crf_name", "Anna Keller"),
    ("she lives at 12 Linden Street today", "crf_street", "12 Linden Street"),
    ("wohnt in der Gartenstraße 14 seit gestern", "crf_street", "Gartenstraße 14"),
    ("please call ٥٥٥-٨٦٧-٥٣٠٩ before noon", "crf_phone", "٥٥٥-٨٦٧-٥٣٠٩"),
]


@pytest.mark.parametrize("text, kind, value", CASES)
def test_values_with_letter_groups(text, kind, value):
    spans = pii.field_spans([text], [pii.base_spans(text)], pii.trained())[0]
    assert (kind, value) in [(pii.KINDS[k], text[a:b]) for a, k, b in spans]


def test_capitalised_prose_is_left_alone():
    for text in ("In der Stadt steht ein Haus und der Garten ist schön", "On Monday the Committee met in Paris", "The House of the River"):
        assert pii.field_spans([text], [[]], pii.trained()) == [[]]


PROSE = [
    "Eses.\nThis Here was said. Then Again it rained", "Licensed under the Apache License, Version 2.0.", "the GNU General Public License, version 3", "Retion Èon. Retion De de la Ville", "Und Und Und Und",
    "Mit Haus und Hof. Der Garten Eden liegt dort", "THE RIVER HOUSE STANDS", "In Berlin Mitte steht ein Turm", "Windows Server with Visual Studio and Office", "my name is\nAnna Keller",
]


@pytest.mark.parametrize("text", PROSE)
def test_two_capitalised_words_are_no_name(text):
    names = [text[a:b] for a, k, b in pii.field_spans([text], [pii.base_spans(text)], pii.trained())[0] if pii.KINDS[k] == "crf_name"]
    assert names == []


def test_few_texts_of_a_table_without_names_hold_one(spark):
    """No names stand in the invented prose of ``documents``: under 1 in 100 texts may seem to hold one."""
    rows = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    found = pii.field_spans(rows, [pii.base_spans(t) for t in rows], pii.trained())
    assert sum(any(pii.KINDS[k] == "crf_name" for _, k, _ in spans) for spans in found) < len(rows) / 100
