import pytest

from larkspur.llm import secret_scan as s

CASES = {
    "SECRET_KEY=x7!kQz9#pL": ["x7!kQz9#pL"],
    "db_password_prod = x7!kQz9#pL": ["x7!kQz9#pL"],
    'secretKey: "x7!kQz9#pL"': ["x7!kQz9#pL"],
    'password: "correct horse battery staple"': ["correct horse battery staple"],
    "pwd: '#!%&*?~', next": ["#!%&*?~"],
    'pwd: "x7!kQz9#pL.': ["x7!kQz9#pL"],
    "secretary: x7!kQz9#pL": [],
    "password: 'letmein'": [],
}


@pytest.mark.parametrize("text", CASES)
def test_guessed_values(text):
    assert [text[a:b] for a, _, b in s.guessed_spans(text, [])] == CASES[text]
