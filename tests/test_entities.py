from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from larkspur.functions import enrich as E
from larkspur.functions import udfs
from larkspur.operators import entities, filters


def one(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i")
    return [r[0] for r in df.select(f(F.col("v"))).collect()]


def test_dates(spark):
    now = F.lit("2024-06-01").cast("timestamp")
    got = one(spark, lambda c: E.moment(c, now), "1714521600000", "1714521600", "2024-05-01T00:00:00Z", "2030-01-01", "soon", None)
    assert got == [datetime(2024, 5, 1)] * 3 + [None] * 3
    assert one(spark, E.unsure_date, "31/01/2024", "01-31-2024", "02/03/2024", "05.05.2024", "x") == [date(2024, 1, 31), date(2024, 1, 31), None, date(2024, 5, 5), None]


def test_slots_across_a_clock_change(spark):
    rows = [("2024-03-30 12:00:00", "daily", 1, 1), ("2024-03-30 05:00:00", "daily", 1, 1), ("2024-03-30 12:00:00", "weekly", 3, 1), ("2024-03-30 12:00:00", "monthly", 1, 31)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, now string, every string, weekday int, monthday int")
    slot = E.next_slot(F.col("now").cast("timestamp"), F.lit("Europe/Rome"), F.lit(8), F.col("every"), F.col("weekday"), F.col("monthday"))
    got = [r.s for r in df.select("i", F.date_format(slot, "yyyy-MM-dd HH:mm").alias("s")).orderBy("i").collect()]
    assert got == ["2024-03-31 06:00", "2024-03-30 07:00", "2024-04-03 06:00", "2024-04-28 06:00"]


def test_declared_pay(spark):
    pay = [
        ('{"currency":"EUR","value":{"minValue":"22.000","maxValue":30000,"unitText":"YEAR"}}', (22000, 30000, "EUR", "year")),
        ('{"currency":"USD","value":{"minValue":1}}', None),
        ('{"value":{"value":"1,500","unitText":"mensile"}}', (1500, 1500, "EUR", "month")),
        ('{"value":"x"}', None),
        (None, None),
    ]
    got = one(spark, lambda c: E.declared_pay(c, F.lit("IT")), *(p for p, _ in pay))
    assert [None if g is None else tuple(g) for g in got] == [w for _, w in pay]


def test_texts(spark):
    assert one(spark, E.languages_required, "Fluent English and German required. French is a plus", "no mention", None) == [["en", "de"], [], None]
    card = one(spark, lambda c: E.detail_card(c, F.lit("Night shift, 40 hours per week, urgent; pension and company car. Apply by 2024-07-01")), "Head of Logistics")[0]
    assert card.management == "director" and card.shifts and card.hours == 40 and card.urgent and card.benefits == ["pension", "car"] and card.valid_through == date(2024, 7, 1)
    assert one(spark, lambda c: E.dense_paragraphs(c, 10), "<p>short</p><div>long <b>enough</b> text</div>") == [["long enough text"]]
    assert one(spark, lambda c: E.about_sentence(c, F.lit("Acme")), "You will love it. Acme is a maker of anvils and rockets, founded by coyotes in the desert. More.") == ["Acme is a maker of anvils and rockets, founded by coyotes in the desert."]
    assert one(spark, E.contact_email, "write to jobs@acme.co.uk.", "none") == ["jobs@acme.co.uk", None]
    assert one(spark, lambda c: E.anchored(F.array(F.lit("C++"), F.lit("Go"), F.lit("Power BI")), c), "We use C++, power-bi and Google") == [["C++", "Power BI"]]
    assert one(spark, E.registry_key, "Acme S.p.A.", "ACME Holding Ltd", "GmbH") == ["acme", "acme holding", None]
    assert one(spark, lambda c: E.by_prefix(c, {"2": "science", "25": "it"}), "2512", "2310", "9") == ["it", "science", None]
    assert one(spark, E.domain_country, "acme.co.uk", "acme.it", "acme.com") == ["GB", "IT", None]
    E.register(spark, ["randstad"])
    assert spark.sql("SELECT normalize_org('A & B'), classify_employer('Randstad Italia'), classify_employer(''), classify_employer('Acme')").first()[:] == ("a b", "staffing_agency", "undisclosed", "direct")


def test_python_functions(spark):
    deep = '{"a": {"Title": "t"}, "list": [1]}'
    assert udfs.deep_value(deep, "title") == "t" and udfs.deep_value(deep, "list") == "[1]" and udfs.deep_value("{", "x") is None
    assert one(spark, lambda c: udfs.deep_key("title")(c), deep, None) == ["t", None]
    assert udfs.merged_sentences("We build big boats. We build big fast boats. Join us!") == "We build big boats. Join us!"
    assert spark.range(1).where(filters.json_list_has_ci(F.lit('["Python","Go"]'), "python")).count() == 1


def test_matchers(spark):
    jobs = spark.createDataFrame([(1, "Senior Software Engineer"), (2, "Software tester"), (3, "Chef in Milan, Italy")], "id int, title string")
    words = spark.createDataFrame([("software", "it"), ("software engineer", "engineering"), ("chef", "food")], "word string, family string")
    assert {r.id: (r.family, r.confidence) for r in entities.classify(jobs, "id", "title", words).collect()} == {1: ("engineering", 0.95), 2: ("it", 0.8333), 3: ("food", 0.5)}
    vocab = spark.createDataFrame([("Software Engineer",), ("Software",), ("Access",)], "label string")
    assert {r.id: r.labels for r in entities.labels(jobs, "id", "title", vocab, "label", ["access"]).collect()} == {1: ["Software", "Software Engineer"], 2: ["Software"]}
    places = spark.createDataFrame([("milan", "IT", 2, 1_300_000), ("milan", "US", 2, 1800), ("italy", "IT", 1, None)], "name string, country string, rank int, population int")
    assert [(r.id, r.country) for r in entities.locate(jobs, "id", "title", places).collect()] == [(3, "IT")]
    first = lambda d: entities.classify(d, "id", "title", words.where("word = 'chef'")).select("id", F.col("family").alias("value"))
    second = lambda d: d.select("id", F.lit("other").alias("value"))
    assert {r.id: (r.value, r.level) for r in entities.cascade(jobs, "id", [("words", first), ("rest", second)]).collect()} == {1: ("other", "rest"), 2: ("other", "rest"), 3: ("food", "words")}
    calls = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, text string")
    assert entities.once_per_text(calls, "text", lambda d: d.select("text_hash", F.length("text").alias("n"))).count() == 3


def test_companies(spark):
    rows = [(1, "acme.com", "acme", 5), (2, "acme.com", "acme italia", 9), (3, "", "acme", 1), (4, "", "acme italia", 2), (5, "", "", 0)]
    df = spark.createDataFrame(rows, "id int, domain string, name string, jobs int")
    got = {r.id: r.canonical for r in entities.canonical_companies(df, "id", "domain", "name", [F.col("jobs").desc(), F.col("id")]).collect()}
    assert got == {1: 2, 2: 2, 3: 2, 4: 2, 5: 5}
    slugs = spark.createDataFrame([("Acme", 3), ("acme", 9), ("other", 1)], "slug string, jobs int")
    assert {(r.slug, r.kept) for r in entities.case_variants(slugs, "slug", [F.col("jobs").desc(), F.col("slug")]).collect()} == {("Acme", "acme"), ("acme", "acme")}
    assert [r.domain for r in entities.shared_domains(df, "domain", "id", 2).where("domain <> ''").collect()] == ["acme.com"]
    ext = spark.createDataFrame([("acme.com", None, 1), ("acme.com", "IT", 2), ("zzz.com", "FR", 3)], "domain string, country string, size int")
    linked = entities.link_records(df.where("id < 3"), ext, "domain", ["country", "size"], [F.col("size")])
    assert {r.id: r.country for r in linked.collect()} == {1: "IT", 2: "IT"}


def test_upsert_with_two_keys(spark):
    target = spark.createDataFrame([("s1", "u1", "a"), ("s2", "u2", "b")], "sid string, url string, v string")
    batch = spark.createDataFrame([("s1", "u9", "A"), ("s7", "u2", "B"), ("s8", "u8", "C"), ("s9", "u8", "C")], "sid string, url string, v string")
    got = {r.url: r.v for r in entities.upsert_two_keys(target, batch, "sid", "url", ["v"]).collect()}
    assert got == {"u1": "A", "u2": "B", "u8": "C"}


@pytest.mark.parametrize("word,want", [("hourly", "hour"), ("monatlich", "month"), ("annually", "year"), ("weeks", "week"), ("and", None)])
def test_period_words(word, want):
    assert udfs.period_of(word) == want
