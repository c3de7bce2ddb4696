"""Record functions: queries over whole tables, and written cases of functions whose queries are in ``columns`` and ``contents``."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import declared as D
from ..functions import enrich as E
from ..functions import text as T
from ..functions import udfs as U
from ..operators import curation, digest, entities, filters, windows
from ..streaming import feed
from .common import table
from .registry import query


def sql_value(x) -> str:
    return "NULL" if x is None else "true" if x is True else "false" if x is False else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"


def cases_sql(outputs: Sequence[str], cases: Sequence[tuple]) -> str:
    """Every order with what its case (by number) must give; a case is (inputs, expected outputs)."""
    rows = ", ".join("(" + ", ".join(map(sql_value, (i, *want))) + ")" for i, (_, want) in enumerate(cases))
    return f"SELECT o_orderkey, {', '.join(outputs)} FROM orders JOIN (VALUES {rows}) x(i, {', '.join(outputs)}) ON i = o_orderkey % {len(cases)}"


def dealt(spark, sf, inputs: str, cases: Sequence[tuple]) -> DataFrame:
    """Every order with the inputs of its case."""
    rows = spark.createDataFrame([(i, *given) for i, (given, _) in enumerate(cases)], f"i long, {inputs}")
    keys = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % len(cases)).alias("i"))
    return keys.join(F.broadcast(rows), "i").drop("i")


#: Cases of functions whose queries read whole columns (``plans.columns``, ``plans.contents``); tests run them.
CASES: dict[str, tuple] = {}
WHOLE = {"accents_folded", "link_kinds", "domain_countries", "contact_address", "nul_removed", "skills_cleaned", "deep_values", "json_merged", "ld_posting", "page_microdata", "technology_anchors"} | {
    "stated_headcount", "language_required", "languages_listed", "intern_evidence", "detail_cards", "grounded_numbers", "grounded_summaries", "company_sentence", "page_paragraphs", "moments", "next_slots", "names_redacted", "structured_salary", "raw_contract",
}


def register(name: str, inputs: str, outputs: dict[str, Callable[[], Column]], cases: Sequence[tuple]) -> None:
    """A query of Column functions over dealt cases, or only their cases where a query reads a whole column."""
    CASES[name] = inputs, outputs, cases
    if name in WHOLE:
        return
    query(cases_sql(list(outputs), cases), name)(lambda spark, sf: dealt(spark, sf, inputs, cases).select("o_orderkey", *(make().alias(out) for out, make in outputs.items())))


def joined(column: Column) -> Column:
    return F.array_join(column, "|")


c = F.col

register(
    "declared_fields", "p string, j string",
    {"hours": lambda: D.declared("hours", c("p"), c("j")), "duration": lambda: D.declared("duration", c("p"), c("j")), "mode": lambda: D.declared("mode", c("p"), c("j")), "level": lambda: D.declared("level", c("p"), c("j")), "language": lambda: D.declared_language(c("p"), c("j"))},
    [
        (("francetravail", '{"dureeTravailLibelle": "39h/semaine", "typeContrat": "CDI", "experienceLibelle": "3 ans"}'), ("full_time", "permanent", None, "mid", None)),
        (("francetravail", '{"dureeTravailLibelle": "Temps partiel - 24h/semaine", "typeContrat": "LIB", "experienceLibelle": "Débutant accepté"}'), ("part_time", "freelance", None, "junior", None)),
        (("francetravail", '{"dureeTravailLibelle": "32h/semaine", "experienceLibelle": "6 mois"}'), (None, None, None, "junior", None)),
        (("arbetsformedlingen", '{"working_hours_type": {"label": "Deltid"}, "employment_type": {"label": "Tidsbegränsad anställning"}, "workplace_model": {"label": "Distans"}, "experience_required": false}'), ("part_time", "fixed_term", "remote", "junior", None)),
        (("arbetsformedlingen", '{"employment_type": {"label": "Vanlig anställning"}, "workplace_model": {"label": "Arbete på plats"}}'), (None, None, "onsite", None, None)),
        (("nav", '{"extent": "Heltid", "engagementtype": "Fast"}'), ("full_time", "permanent", None, None, None)),
        (("smartrecruiters", '{"typeOfEmployment": {"label": "Intern"}, "experienceLevel": {"label": "Mid-Senior Level"}, "location": {"remote": true}, "language": {"code": "en-GB"}}'), (None, "internship", "remote", "senior", "en")),
        (("smartrecruiters", '{"typeOfEmployment": {"label": "Contract"}, "language": {"code": "xx"}}'), (None, None, None, None, None)),
        (("recruitee", '{"employment_type_code": "fulltime_fixed_term", "hybrid": true, "remote": true, "experience_code": "manager"}'), ("full_time", "fixed_term", "hybrid", "lead", None)),
        (("recruitee", '{"employment_type_code": "freelance", "hybrid": false, "remote": false}'), (None, "freelance", "onsite", None, None)),
        (("workable", '{"employment_type": "Temporary", "workplace": "on_site", "experience": "Entry level"}'), (None, "fixed_term", "onsite", "junior", None)),
        (("ashby", '{"employmentType": "FullTime", "workplaceType": "Hybrid"}'), ("full_time", None, "hybrid", None, None)),
        (("personio", '{"employmentType": "working_student"}'), ("part_time", None, None, None, None)),
        (("bamboohr", '{"employmentStatusLabel": "Seasonal Part-Time"}'), ("part_time", "fixed_term", None, None, None)),
        (("breezy", '{"type": {"id": "fullTime", "name": "Vollzeit"}}'), ("full_time", None, None, None, None)),
        (("zohorecruit", '{"Job_Type": "Teilzeit", "Remote_Job": "false"}'), ("part_time", None, "onsite", None, None)),
        (("pinpoint", '{"employment_type": "permanent_full_time", "workplace_type": "remote"}'), ("full_time", "permanent", "remote", None, None)),
        (("recruiterbox", '{"positionType": "part_time"}'), ("part_time", None, None, None, None)),
        (("vincere", '{"type": "Locum"}'), (None, "fixed_term", None, None, None)),
        (("jsonld", '{"employmentType": ["FULL_TIME"], "jobLocationType": "TELECOMMUTE"}'), ("full_time", None, "remote", None, None)),
        (("jsonld", '{"employmentType": ["FULL_TIME", "PART_TIME"]}'), (None, None, None, None, None)),
        (("jsonld", '{"employmentType": "Per Diem"}'), (None, "fixed_term", None, None, None)),
        (("icims", '{"Position Type": "Regular Full-Time", "Location Type": "On site"}'), ("full_time", "permanent", "onsite", None, None)),
        (("lever", '{"categories": {"commitment": "Contract Full time"}}'), ("full_time", None, None, None, None)),
        (("lever", '{"categories": {"commitment": "Remote"}}'), (None, None, "remote", None, None)),
        (("join", '{"workplaceType": "HYBRID"}'), (None, None, "hybrid", None, None)),
        (("greenhouse", '{"language": "fr_FR"}'), (None, None, None, None, "fr")),
        (("werecruit", '{"DefaultLanguage": "nl-be"}'), (None, None, None, None, "nl")),
        (("greenhouse", '{"workplaceType": "remote"}'), (None, None, None, None, None)),
        (("lever", None), (None, None, None, None, None)),
    ],
)

FACT_CASES = [
    (("workable", '{"experience": "Director", "workplace": "remote", "employment_type": "Part-time"}', "Junior analyst (hybrid)", "Rome", "SQL and Python"), ("head", "remote", "part_time", "python|sql")),
    (("other", '{"workplaceType": "Hybrid", "jobType": "Temporary"}', "Senior analyst, remote", "Rome", "rust"), ("senior", "hybrid", "temporary", "rust")),
    (("other", '{"remote": 1}', "Head of data", "hybrid", ""), ("head", "remote", None, "")),
    (("other", "{}", "Praktikum Einkauf", "Home office", "Rusty SQL-Server"), ("intern", "remote", "internship", "sql")),
    (("ashby", '{"employmentType": "FullTime"}', "Engineer", "Oslo", None), (None, None, "full_time", "")),
]


@query(cases_sql(["level", "mode", "contract", "skills"], FACT_CASES))
def listing_facts(spark, sf):
    """Declared values win over common keys, these over the title and the text."""
    rows = dealt(spark, sf, "p string, j string, title string, place string, text string", FACT_CASES)
    found = rows.select("o_orderkey", D.facts(c("p"), c("j"), c("title"), c("place"), c("text"), ["python", "sql", "rust"]).alias("f"))
    return found.select("o_orderkey", "f.level", "f.mode", "f.contract", joined(c("f.skills")).alias("skills"))


PAY_CASES = [
    (('{"salaryRange": {"min": 50000, "max": 60000, "currency": "usd", "interval": "per-year-salary"}}', "US"), (50000, 60000, "USD", "year")),
    (('{"salary_range": {"max": 25, "currency": "EUR", "interval": "hourly"}}', "IT"), (25, 25, "EUR", "hour")),
    (('{"salary": {"min": 1800, "max": 2100, "currency": "CHF"}}', "CH"), (1800, 2100, "CHF", None)),
    (('{"salary": "£31,000 to £33,500 a year"}', "GB"), (31000, 33500, "GBP", "year")),
    (('{"salary": "", "compensation": "EUR 14,50 / hour"}', "FR"), (14.5, 14.5, "EUR", "hour")),
    (('{"baseSalary": {"currency": "EUR", "value": {"minValue": "24.000", "maxValue": 27000, "unitText": "YEAR"}}}', "IT"), (24000, 27000, "EUR", "year")),
    (('{"baseSalary": {"currency": "USD", "value": {"minValue": 24000}}}', "IT"), (None, None, None, None)),
    (('{"baseSalary": {"value": {"value": "1,900", "unitText": "mensile"}}}', "ES"), (1900, 1900, "EUR", "month")),
    (('{"salary": "good"}', "US"), (None, None, None, None)),
    (('{"salaryRange": {"min": -5, "currency": "EUR"}}', "IT"), (None, None, None, None)),
    (("{broken", "US"), (None, None, None, None)),
    ((None, "US"), (None, None, None, None)),
]


register("structured_salary", "j string, country string", {part: lambda part=part: D.structured_pay(c("j"), c("country"), U.field_salary(D.pay_string(c("j"))))[part] for part in ("low", "high", "currency", "period")}, PAY_CASES)


register("language_required", "t string", {"code": lambda: T.required_language(c("t"))}, [
    (("You are fluent in spoken German",), ("de",)), (("native Dutch speaker",), ("nl",)), (("French is mandatory here",), ("fr",)), (("Italian language is a must",), ("it",)), (("business-level Japanese",), ("ja",)),
    (("proficiency in Polish",), ("pl",)), (("our Swedish office is nice",), (None,)), (("fluent English only",), (None,)), (("Danish or Norwegian required",), ("no",)), ((None,), (None,)),
])
register("languages_listed", "t string", {"codes": lambda: joined(E.languages_required(c("t")))}, [
    (("Fluent English and German required. French is a plus",), ("en|de",)), (("Ottima conoscenza di inglese e tedesco; gradito francese",), ("en|de",)), (("Deutsch fließend in Wort und Schrift; Englisch von Vorteil",), ("de",)),
    (("Anglais courant exigé. Espagnol apprécié",), ("en",)), (("We love languages",), ("",)), (("Svenska är ett krav",), ("sv",)), ((None,), (None,)),
])
register("intern_evidence", "title string, t string, lang string", {"intern": lambda: T.internship_evidence(c("title"), c("t"), c("lang"))}, [
    (("Marketing intern", "", "en"), (True,)), (("Senior manager", "we also offer internships", "en"), (False,)), (("Buyer", "an internship, as an apprentice", "en"), (True,)), (("Stage commercial", "", "fr"), (True,)),
    (("Early stage startup", "", "en"), (False,)), (("Tirocinio curricolare", None, "it"), (True,)), (("软件实习", "", "zh"), (True,)), (("International sales", "internal", "en"), (False,)), ((None, None, None), (False,)),
])
register("ld_posting", "h string", {"title": lambda: F.get_json_object(T.job_posting(c("h")), "$.title")}, [
    (('<script type="application/ld+json">{"@type": "JobPosting", "title": "Cook"}</script>',), ("Cook",)), (('<script type="application/ld+json">[{"@type": "Org"}, {"@type": "JobPosting", "title": "Nurse"}]</script>',), ("Nurse",)),
    (('<script type="application/ld+json">{"@graph": [{"@type": "JobPosting", "title": "Smith"}]}</script>',), ("Smith",)), (('<script type="application/ld+json">{bad</script>',), (None,)), (("<p>JobPosting</p>",), (None,)),
])
register("page_microdata", "h string", {"title": lambda: E.microdata(c("h"))["title"], "company": lambda: E.microdata(c("h"))["company"], "posted": lambda: E.microdata(c("h"))["posted"]}, [
    (('<div itemscope itemtype="https://schema.org/JobPosting"><h1 itemprop="title">Night <b>baker</b></h1><span itemprop="hiringOrganization">Oven Ltd</span><meta itemprop="datePosted" content="2024-05-02"></div>',), ("Night baker", "Oven Ltd", "2024-05-02")),
    (('<div itemtype="http://schema.org/JobPosting"><meta itemprop="title" content="Driver"></div>',), ("Driver", None, None)), (('<h1 itemprop="title">Shop</h1>',), (None, None, None)),
])
register("page_paragraphs", "h string", {"paragraphs": lambda: joined(E.dense_paragraphs(c("h"), 12))}, [
    (("<p>short</p><div>long <b>enough</b> text</div><script>var not_shown = 1;</script>",), ("long enough text",)), (("<ul><li>a first item here</li><li>no</li><li>and a second one</li></ul>",), ("a first item here|and a second one",)), (("",), ("",)),
])
register("company_sentence", "t string, n string", {"about": lambda: E.about_sentence(c("t"), c("n"), 30)}, [
    (("You will like it. Acme is a maker of anvils and rockets since 1949. Join.", "ACME"), ("Acme is a maker of anvils and rockets since 1949.",)), (("Acme is looking for your talent in this role now.", "Acme"), (None,)), (("Zeta provides water pumps to farms in the south.", "Acme"), (None,)),
])
register("stated_headcount", "t string", {"counts": lambda: joined(F.transform(T.headcounts(c("t")), lambda n: n.cast("string")))}, [
    (("We are 1.250 employees in 3 sites",), ("1250",)), (("Since 2015 people joined us; 40 dipendenti oggi",), ("40",)), (("2 people",), ("",)), (("over 300+ collaborateurs and 12,000 customers",), ("300",)),
])
register("contact_address", "t string", {"mail": lambda: E.contact_email(c("t"))}, [(("write to jobs@firm.example.org.",), ("jobs@firm.example.org",)), (("no address @ all",), (None,)), (("a@b.co, c@d.co",), ("a@b.co",))])
register("technology_anchors", "t string", {"found": lambda: joined(E.anchored(F.array(*map(F.lit, ("C++", "Go", "Power BI", "C#"))), c("t")))}, [
    (("We use C++, power-bi and Google",), ("C++|Power BI",)), (("go go go",), ("Go",)), (("C sharp",), ("",)), (("C#/.NET",), ("C#",)),
])
register("grounded_numbers", "s string, t string", {"kept": lambda: T.numbers_grounded(c("s"), c("t"))}, [
    (("We were 1.200. Then 4500 came. Fine.", "We had 1200 in 2021"), ("We were 1.200. Fine.",)), (("All 350 agree!", "350"), ("All 350 agree!",)), (("Only 12.", "nothing"), ("Only 12.",)),
])
register("grounded_summaries", "s string, t string", {"kept": lambda: T.numbers_grounded(c("s"), c("t"), 4)}, [
    (("We grew a lot. Now 4500 people work here.", "we grew"), ("We grew a lot.",)), (("We grew. Now 4500 people work here.", "we grew"), (None,)), (("", ""), (None,)),
])
register("json_merged", "a string, b string", {"merged": lambda: U.merged_json(c("a"), c("b"))}, [
    (('{"a": 1, "b": {"x": 1}}', '{"b": [2], "c": "é"}'), ('{"a": 1, "b": [2], "c": "é"}',)), (("{bad", '{"k": null}'), ('{"k": null}',)), (("[1]", None), (None,)),
])
register("sentences_merged", "t string", {"kept": lambda: U.without_similar_sentences(c("t"))}, [
    (("We build big boats. We build big fast boats. Join us!",), ("We build big boats. Join us!",)), (("One two three. Four five six.",), ("One two three. Four five six.",)), (("",), ("",)),
])
register("names_alike", "a string, b string", {"score": lambda: F.round(U.similar_names(c("a"), c("b")), 4)}, [
    (("Acme Inc", "ACME inc."), (1.0,)), (("Acme", "Acme Holding"), (1.0,)), (("abcd", "abxy"), (0.5,)), (("", "x"), (0.0,)), ((None, "x"), (None,)),
])
register("skills_cleaned", "t string", {"skills": lambda: joined(T.clean_skills(F.split(c("t"), ";"), ["teamwork"]))}, [
    (("SQL (lang);sql;Machine Learning;x;JavaScript;excel",), ("SQL|Machine Learning|JavaScript|excel",)), (("Teamwork;  Go ;go",), ("go",)), (("",), ("",)),
])
register("accents_folded", "t string", {"folded": lambda: T.fold(c("t")), "bare": lambda: U.bare(c("t"))}, [(("Élan naïve ñ",), ("Elan naive n", "Elan naive n")), (("Malmö Århus",), ("Malmo Arhus", "Malmo Arhus")), (("ﬁn",), ("ﬁn", "fin")), ((None,), (None, None))])
register("moments", "t string", {"moment_at": lambda: F.date_format(E.moment(c("t"), F.lit("2024-06-01").cast("timestamp")), "yyyy-MM-dd HH:mm")}, [
    (("1714521600000",), ("2024-05-01 00:00",)), (("1714521600",), ("2024-05-01 00:00",)), (("2024-05-01T10:30:00+02:00",), ("2024-05-01 08:30",)), (("2030-01-01",), (None,)), (("soon",), (None,)), ((None,), (None,)),
])
register("next_slots", "n string, e string, w int, d int", {"slot": lambda: F.date_format(E.next_slot(c("n").cast("timestamp"), F.lit("Europe/Rome"), F.lit(8), c("e"), c("w"), c("d")), "yyyy-MM-dd HH:mm")}, [
    (("2024-03-30 12:00:00", "daily", 1, 1), ("2024-03-31 06:00",)), (("2024-03-30 05:00:00", "daily", 1, 1), ("2024-03-30 07:00",)), (("2024-03-30 12:00:00", "weekly", 3, 1), ("2024-04-03 06:00",)), (("2024-03-30 12:00:00", "monthly", 1, 31), ("2024-04-28 06:00",)),
])
register("deep_values", "j string", {"v": lambda: U.deep_key("title")(c("j"))}, [(('{"a": {"Title": "t"}, "list": [1]}',), ("t",)), (('{"title": "", "x": {"title": "u"}}',), ("u",)), (('{"title": 3}',), ("3",)), (("{",), (None,)), ((None,), (None,))])
register("link_kinds", "u string", {"kind": lambda: T.link_kind(c("u"))}, [(("https://www.linkedin.com/jobs/1",), ("job_board",)), (("http://a.nav.no/y",), ("national_agency",)), (("https://acme.example/x",), ("career_site",)), (("",), (None,)), ((None,), (None,))])
register("domain_countries", "h string", {"country": lambda: E.domain_country(c("h"))}, [(("acme.co.uk",), ("GB",)), (("acme.it",), ("IT",)), (("acme.com",), (None,)), ((None,), (None,))])
register("nul_removed", "t string", {"t2": lambda: F.translate(c("t"), "\x00", "")}, [(("a b",), ("a b",)), (("",), ("",))])
register("names_redacted", "t string", {"t2": lambda: T.redact_name(c("t"), T.head_name(c("t")))}, [
    (("Curriculum Vitae\nEva van Holt\nEva sings. Mr Holt too.",), ("Curriculum Vitae\n[CANDIDATE]\n[CANDIDATE] sings. Mr [CANDIDATE] too.",)), (("sales since 2019\nno name",), ("sales since 2019\nno name",)), (("Profile Summary\nJan Kowalski\nJanuary",), ("Profile Summary\n[CANDIDATE]\nJanuary",)),
])
register("raw_contract", "j string", {"contract": lambda: T.contract_of(c("j"))}, [
    (('{"jobType": "Vollzeit", "employment_type": {"label": "Vikariat"}}',), ("temporary",)), (('{"timeType": "Part time"}',), ("part_time",)), (('{"commitment": "Regular", "workingHours": "Heltid"}',), ("full_time",)), (("{}",), (None,)), ((None,), (None,)),
])
register("detail_cards", "title string, t string", {
    "management": lambda: E.detail_card(c("title"), c("t"))["management"], "shifts": lambda: E.detail_card(c("title"), c("t"))["shifts"], "hours": lambda: E.detail_card(c("title"), c("t"))["hours"], "urgent": lambda: E.detail_card(c("title"), c("t"))["urgent"],
    "benefits": lambda: joined(E.detail_card(c("title"), c("t"))["benefits"]), "until": lambda: F.date_format(E.detail_card(c("title"), c("t"))["valid_through"], "yyyy-MM-dd"), "pay": lambda: E.detail_card(c("title"), c("t"))["salary_text"], "contact": lambda: E.detail_card(c("title"), c("t"))["contact"],
}, [
    (("Head of Logistics", "Night shift, 40 hours per week, urgent. Pension and company car. Apply by 2024-07-01."), ("director", True, 40, True, "pension|car", "2024-07-01", None, None)),
    (("Store manager", "We train you. The salary is 30.000 € gross. Write to a@b.co now."), ("manager", False, None, False, "", None, "The salary is 30.000 € gross.", "a@b.co")),
    (("Cook", "turni, 35 ore a settimana, buoni pasto"), (None, True, 35, False, "meals", None, None, None)),
])

PLACE_CASES = [
    (("Berlin, Germany",), ("DE",)), (("Austin, TX",), ("US",)), (("Bengaluru, IN",), ("IN",)), (("Gary, IN",), ("US",)), (("Remote - UK",), ("GB",)), (("Toronto",), ("CA",)), (("Greater Paris area",), ("FR",)), (("Georgia",), ("US",)),
    (("Springfield / Toronto",), ("CA",)), (("Nowhere",), (None,)), (("",), (None,)), ((None,), (None,)), (("Köln",), ("DE",)), (("U.S. Remote",), ("US",)), (("Aix-en-Provence",), ("FR",)),
]


@query("""
WITH m AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 11 END AS cluster, (o_totalprice / 5000) AS score FROM orders),
s AS (SELECT * FROM m WHERE o_orderkey % 7 = 0),
g AS (SELECT m.* FROM m WHERE score >= 40 AND NOT EXISTS (SELECT 1 FROM s WHERE s.o_custkey = m.o_custkey AND s.o_orderkey = m.o_orderkey) AND NOT EXISTS (SELECT 1 FROM s WHERE s.o_custkey = m.o_custkey AND s.cluster = m.cluster)),
o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, coalesce('c' || cluster, 'i' || o_orderkey) ORDER BY score DESC, o_orderkey) AS r FROM g)
SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, o_orderkey) AS rn FROM o WHERE r = 1) WHERE rn <= 5
""")
def digest_selection(spark, sf):
    """A top-k report: at most five new matches a customer, one a cluster."""
    matches = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 11).alias("cluster"), (F.col("o_totalprice") / 5000).alias("score"))
    return digest.digest(matches, matches.where("o_orderkey % 7 = 0"), "o_custkey", "o_orderkey", "cluster", "score", ["o_orderkey"], 40, 5).select("o_custkey", "o_orderkey")


@query("SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) AS b FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_totalprice ORDER BY o_orderdate DESC, o_orderkey) AS a FROM orders) WHERE a = 1) WHERE b = 1")
def bridge_dedup(spark, sf):
    """Of listings that several sources carry the newest stays, by one key and then by another."""
    return curation.first_of(table(spark, sf, "orders"), [[F.col("o_custkey"), F.col("o_totalprice")], [F.col("o_custkey"), F.col("o_orderpriority")]], [F.col("o_orderdate").desc(), F.col("o_orderkey")]).select("o_orderkey")


@query("SELECT event_id FROM events WHERE ts >= greatest(CASE WHEN user_id % 2 = 0 THEN TIMESTAMP '2024-01-20' ELSE TIMESTAMP '2024-01-30' END, TIMESTAMP '2024-01-24')")
def changes_look_back(spark, sf):
    """A stated start, or a day back; never from before the horizon of seven days."""
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    since = F.when(F.col("user_id") % 2 == 0, F.lit("2024-01-20").cast("timestamp"))
    return feed.look_back(events, "ts", F.lit("2024-01-31").cast("timestamp"), since).select("event_id")


@query("""
WITH t AS (SELECT 's' || o_custkey AS sid, 'u' || o_orderkey AS url, o_orderstatus AS v FROM orders WHERE o_orderkey % 3 = 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1),
b AS (SELECT 's' || o_custkey AS sid, 'u' || CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE -o_orderkey END AS url, 'new' AS v FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1),
r AS (SELECT * FROM b WHERE sid NOT IN (SELECT sid FROM t))
SELECT t.sid, t.url, coalesce(b2.v, b.v, t.v) AS v FROM t LEFT JOIN b ON b.sid = t.sid LEFT JOIN r b2 ON b2.url = t.url
UNION ALL SELECT sid, url, v FROM r WHERE url NOT IN (SELECT url FROM t)
""")
def upsert_by_two_keys(spark, sf):
    orders = table(spark, sf, "orders")
    sid = F.concat(F.lit("s"), F.col("o_custkey").cast("string"))
    target = windows.top_per_group(orders.where("o_orderkey % 3 = 0"), ["o_custkey"], [F.col("o_orderkey")], 1).select(sid.alias("sid"), F.concat(F.lit("u"), F.col("o_orderkey").cast("string")).alias("url"), F.col("o_orderstatus").alias("v"))
    signed = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")).otherwise(-F.col("o_orderkey")).cast("string")
    batch = windows.top_per_group(orders, ["o_custkey"], [F.col("o_orderkey").desc()], 1).select(sid.alias("sid"), F.concat(F.lit("u"), signed).alias("url"), F.lit("new").alias("v"))
    return entities.upsert_two_keys(target, batch, "sid", "url", ["v"])


@query("SELECT p_partkey, CASE WHEN contains(p_name, 'red') THEN 'word' WHEN p_size > 25 THEN 'size' ELSE 'rest' END AS level FROM part")
def label_cascade(spark, sf):
    by_word = lambda d: d.where(F.col("p_name").contains("red")).select("p_partkey", F.lit("w").alias("value"))
    by_size = lambda d: d.where("p_size > 25").select("p_partkey", F.lit("s").alias("value"))
    rest = lambda d: d.select("p_partkey", F.lit("r").alias("value"))
    return entities.cascade(table(spark, sf, "part"), "p_partkey", [("word", by_word), ("size", by_size), ("rest", rest)]).select("p_partkey", "level")


@query("SELECT p_partkey, term FROM part JOIN (VALUES ('PROMO'), ('Brand#1'), ('the small red gear of the old mill house')) t(term) ON contains(' ' || lower(regexp_replace(p_name || ' ' || p_type || ' the small red gear of the old mill house ' || p_brand, '[^\\p{L}\\p{N}+#]+', ' ', 'g')) || ' ', ' ' || lower(term) || ' ')")
def long_terms(spark, sf):
    """Terms of any number of words, found as whole words."""
    terms = spark.createDataFrame([("PROMO",), ("Brand#1",), ("the small red gear of the old mill house",)], "term string")
    rows = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type", F.lit("the small red gear of the old mill house"), "p_brand").alias("t"))
    return entities.matched(rows, "p_partkey", "t", terms, "term").select("p_partkey", "term")


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS pearson FROM lineitem")
def pearson(spark, sf):
    return curation.pearson(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


@query("""
WITH s AS (SELECT n_chars AS t, quality = 1 AS y FROM labels JOIN documents USING (doc_id)), c AS (SELECT DISTINCT t FROM s),
f AS (SELECT c.t, 2.0 * count(*) FILTER (WHERE s.t >= c.t AND y) / (count(*) FILTER (WHERE s.t >= c.t) + count(*) FILTER (WHERE y)) AS f1 FROM c, s GROUP BY 1)
SELECT CAST(t AS BIGINT) AS threshold, round(f1, 6) AS f1 FROM f ORDER BY f1 DESC, t DESC LIMIT 1
""")
def best_f1(spark, sf):
    """The score from which on taking rows for good gives the best f1."""
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return curation.best_threshold(rows, F.col("quality") == 1, "n_chars")


@query("""
SELECT lang, count(*) AS n, count(*) FILTER (WHERE h IN (SELECT h FROM (SELECT sha1(text) AS h FROM documents) GROUP BY 1 HAVING count(*) > 1)) AS copies, count(*) FILTER (WHERE w > 400) AS cut, count(*) FILTER (WHERE w < 20) AS short,
  count(*) FILTER (WHERE nums > 0) AS numbers, count(*) FILTER (WHERE caps) AS names, count(*) FILTER (WHERE lang NOT IN ('en', 'de', 'fr', 'es')) AS odd_language, CAST(quantile_disc(w, 0.5) AS BIGINT) AS median_words
FROM (SELECT lang, sha1(text) AS h, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS w, len(regexp_extract_all(text, '[0-9]{3,}')) AS nums, regexp_matches(text, '(^|[^A-Za-z])[A-Z][a-z]+ [A-Z][a-z]+') AS caps FROM documents) GROUP BY 1
""")
def dataset_audit(spark, sf):
    """Checks of a training set: copies, cut and short rows, numbers and names that stayed, languages, lengths."""
    words = F.size(F.filter(F.split("text", "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")).cast("long")
    return curation.audit(table(spark, sf, "documents"), "lang", F.col("text"), words, most_words=400, least_words=20, known=("en", "de", "fr", "es"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE event_type = 'click') WHERE rn <= 3")
def views_by_sql(spark, sf):
    """A report written in the session's own SQL, over registered views and functions."""
    filters.register_views(spark, {"clicks_v": table(spark, sf, "events").where("event_type = 'click'")})
    return spark.sql("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM clicks_v) WHERE rn <= 3")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate - INTERVAL 2 HOURS >= TIMESTAMP '1998-03-01 22:00:00'")
def filter_posted_after(spark, sf):
    """A lower bound with an offset against times written with another one; both are compared in UTC."""
    written = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    now = F.lit("2030-01-01").cast("timestamp")
    bound = E.moment(F.lit("1998-03-02T01:00:00+03:00"), now)
    return table(spark, sf, "orders").where(E.moment(written, now) >= bound).select("o_orderkey")


@query("""
WITH t AS (SELECT source FROM documents GROUP BY 1 ORDER BY count(*) DESC, source LIMIT 6)
SELECT lang, CASE WHEN source IN (SELECT source FROM t) THEN source ELSE 'other' END AS source, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1, 2
""")
def largest_sources(spark, sf):
    """Rows a language of the six largest sources; the others as one."""
    from ..operators import aggregates

    return aggregates.of_largest(table(spark, sf, "documents"), ["lang"], "source", 6)


@query("""
SELECT 'errors' AS rule, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END), 6) AS value, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END) > 0.05 AS fires FROM events
UNION ALL SELECT 'silent users', CAST(count(DISTINCT user_id) AS DOUBLE), count(DISTINCT user_id) < 3 FROM events
UNION ALL SELECT 'no value', CAST(count(*) FILTER (WHERE value IS NULL OR value = 0) AS DOUBLE), count(*) FILTER (WHERE value IS NULL OR value = 0) > 0 FROM events
UNION ALL SELECT 'stale', round(date_diff('second', max(ts), TIMESTAMP '2024-03-01') / 86400.0, 6), date_diff('second', max(ts), TIMESTAMP '2024-03-01') / 86400.0 > 7 FROM events
""")
def anomaly_rules(spark, sf):
    """Several rules over one pass: a share, a count of different values, a count, an age."""
    from ..operators import aggregates

    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    age = (F.unix_timestamp(F.lit("2024-03-01").cast("timestamp")) - F.unix_timestamp(F.date_trunc("second", F.max("ts")))) / 86400.0
    return aggregates.alerts(events, {
        "errors": (F.avg(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)), F.col("errors") > 0.05), "silent users": (F.count_distinct("user_id"), F.col("silent users") < 3),
        "no value": (F.count_if(F.col("value").isNull() | (F.col("value") == 0)), F.col("no value") > 0), "stale": (age, F.col("stale") > 7),
    })


@query("""
WITH s AS (SELECT quality = 1 AS t, n_chars AS s FROM labels JOIN documents USING (doc_id)), x AS (SELECT unnest([200, 800, 2000, 100000000]) AS threshold),
c AS (SELECT threshold, count(*) FILTER (WHERE t AND s >= threshold) AS tp, count(*) FILTER (WHERE NOT t AND s >= threshold) AS fp, count(*) FILTER (WHERE t AND s < threshold) AS fn FROM s, x GROUP BY 1)
SELECT threshold, tp, fp, fn, round(tp / nullif(tp + fp, 0), 4) AS precision, round(tp / nullif(tp + fn, 0), 4) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 4) AS f1 FROM c
""")
def threshold_sweep(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return curation.threshold_sweep(rows, F.col("quality") == 1, "n_chars", [200, 800, 2000, 100_000_000])


@query("""
WITH r AS (SELECT DISTINCT CASE WHEN o_orderkey % 3 = 0 THEN upper('seg' || c_nationkey) WHEN o_orderkey % 3 = 1 THEN 'Seg' || c_nationkey ELSE 'seg' || c_nationkey END AS k, o_custkey AS i FROM orders JOIN customer ON o_custkey = c_custkey),
n AS (SELECT k, count(*) AS n FROM r GROUP BY 1),
p AS (SELECT a.k, b.k AS o, count(*) AS sh FROM r a JOIN r b ON lower(a.k) = lower(b.k) AND a.i = b.i AND a.k <> b.k GROUP BY 1, 2),
g AS (SELECT p.k, p.o, m.n AS m FROM p JOIN n ON n.k = p.k JOIN n m ON m.k = p.o WHERE sh >= 0.5 * least(n.n, m.n) AND (m.n > n.n OR (m.n = n.n AND p.o < p.k)))
SELECT k, o AS kept FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY m DESC, o) AS rn FROM g) WHERE rn = 1
""")
def variants_merged(spark, sf):
    """Spellings that share most of their members become one."""
    name = F.concat(F.lit("seg"), F.col("c_nationkey").cast("string"))
    third = F.col("o_orderkey") % 3
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return entities.variants_by_ids(rows.select(F.when(third == 0, F.upper(name)).when(third == 1, F.initcap(name)).otherwise(name).alias("k"), "o_custkey"), "k", "o_custkey")
