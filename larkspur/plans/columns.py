"""Record functions over whole columns of the tables; the SQL states each rule. Their special cases are in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import enrich as E
from ..functions import text as T
from ..functions import udfs as U
from .common import table
from .registry import query


@query("SELECT doc_id, sha256(strip_accents(text)) AS folded, sha256(strip_accents(text)) AS bare FROM documents")
def accents_folded(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(T.fold(F.col("text")), 256).alias("folded"), F.sha2(U.bare(F.col("text")), 256).alias("bare"))


@query("""
SELECT page_id, CASE WHEN host = 'example.org' OR host LIKE '%.example.org' THEN 'national_agency' WHEN host = 'example.net' OR host LIKE '%.example.net' THEN 'job_board' ELSE 'career_site' END AS kind
FROM (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host FROM pages)
""")
def link_kinds(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.link_kind(F.col("url"), ["example.org"], ["example.net"]).alias("kind"))


@query("SELECT page_id, CASE regexp_extract(url, '^https?://[^/]+/([a-z]+)', 1) WHEN 'de' THEN 'DE' WHEN 'fr' THEN 'FR' WHEN 'es' THEN 'ES' WHEN 'en' THEN 'GB' END AS country FROM pages")
def domain_countries(spark, sf):
    """The pages' hosts under the top-level domain that their language names."""
    top = F.regexp_extract("url", "^https?://[^/]+/([a-z]+)", 1)
    host = F.concat(T.domain(F.col("url")), F.lit("."), F.when(top == "en", "co.uk").otherwise(top))
    return table(spark, sf, "pages").select("page_id", E.domain_country(host).alias("country"))


@query(r"SELECT doc_id, nullif(regexp_extract(text, '\b([A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)+)\b', 1), '') AS mail FROM documents")
def contact_address(spark, sf):
    return table(spark, sf, "documents").select("doc_id", E.contact_email(F.col("text")).alias("mail"))


@query("SELECT doc_id, sha256(replace(replace(text, 'e', ''), chr(10), '')) AS cleaned FROM documents")
def nul_removed(spark, sf):
    """Texts in which each e and each line break was turned into a NUL."""
    holed = F.translate(F.col("text"), "e\n", "\x00\x00")
    return table(spark, sf, "documents").select("doc_id", F.sha2(F.translate(holed, "\x00", ""), 256).alias("cleaned"))


@query("""
WITH v AS (SELECT p_partkey, unnest(generate_series(1, 7)) AS i, unnest([p_name, upper(p_name), p_type || ' (old) ', lower(p_type), p_brand, ' ' || p_brand, substr(p_name, 1, 1)]) AS raw FROM part),
b AS (SELECT p_partkey, i, trim(regexp_replace(trim(raw), '\\s*\\([^)]*\\)\\s*$', '')) AS v FROM v),
f AS (SELECT *, row_number() OVER (PARTITION BY p_partkey, lower(v) ORDER BY i) AS n FROM b WHERE length(v) >= 2 AND lower(v) NOT IN ('', 'red plate'))
SELECT p_partkey, string_agg(CASE WHEN v = upper(v) OR regexp_matches(substr(v, 2), '[A-Z]') THEN v ELSE lower(v) END, '|' ORDER BY i) AS skills FROM f WHERE n = 1 GROUP BY 1
""")
def skills_cleaned(spark, sf):
    values = F.array("p_name", F.upper("p_name"), F.concat("p_type", F.lit(" (old) ")), F.lower("p_type"), "p_brand", F.concat(F.lit(" "), "p_brand"), F.substring("p_name", 1, 1))
    return table(spark, sf, "part").select("p_partkey", F.array_join(T.clean_skills(values, ["red plate"]), "|").alias("skills"))


@query("SELECT click_id, CASE WHEN json_valid(props) THEN json_extract_string(props, '$.device.os') END AS os, CASE WHEN json_valid(props) THEN json_extract_string(props, '$.k') END AS k FROM clicks")
def deep_values(spark, sf):
    return table(spark, sf, "clicks").select("click_id", U.deep_key("os")(F.col("props")).alias("os"), U.deep_key("K")(F.col("props")).alias("k"))


@query("""SELECT event_id, '{"id": ' || event_id || ', "k": ' || json_extract_string(props, '$.k') || ', "kind": "' || event_type || '"}' AS merged FROM events""")
def json_merged(spark, sf):
    """The later object's values win; keys come out in their order."""
    own = F.format_string('{"k": 0, "id": %d, "kind": "%s"}', "event_id", "event_type")
    return table(spark, sf, "events").select("event_id", U.merged_json(own, F.col("props")).alias("merged"))


@query("SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN regexp_replace(url, '[^A-Za-z/:.]', '', 'g') END AS title FROM pages")
def ld_posting(spark, sf):
    """Every page with a posting of its address' letters in it, in one of two forms, but for each third."""
    title = F.regexp_replace("url", "[^A-Za-z/:.]", "")
    one = F.concat(F.lit('{"@type": "JobPosting", "title": "'), title, F.lit('"}'))
    held = F.when(F.col("page_id") % 3 == 1, one).when(F.col("page_id") % 3 == 2, F.concat(F.lit('[{"@type": "Organization"}, '), one, F.lit("]")))
    html = F.concat("html", F.coalesce(F.concat(F.lit('<script type="application/ld+json">'), held, F.lit("</script>")), F.lit("")))
    return table(spark, sf, "pages").select("page_id", F.get_json_object(T.job_posting(html), "$.title").alias("title"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN regexp_replace(url, '[^A-Za-z/:.]', '', 'g') END AS title, CASE WHEN page_id % 2 = 0 THEN '2024-01-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') END AS posted FROM pages")
def page_microdata(spark, sf):
    """Every page behind an item of its address' letters, which is a posting on each second one."""
    kind = F.when(F.col("page_id") % 2 == 0, "JobPosting").otherwise("Article")
    item = F.concat(F.lit('<div itemscope itemtype="https://schema.org/'), kind, F.lit('"><h1 itemprop="title">'), F.regexp_replace("url", "[^A-Za-z/:.]", ""), F.lit('</h1><meta itemprop="datePosted" content="2024-01-'), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0"), F.lit('"></div>'))
    facts = E.microdata(F.concat(item, "html"))
    return table(spark, sf, "pages").select("page_id", facts["title"].alias("title"), facts["posted"].alias("posted"))


TECHNOLOGIES = ("The", "Mit der", "C++", "of the", "que", "V2.0")


@query("""
SELECT doc_id, array_to_string(list_filter(['The', 'Mit der', 'C++', 'of the', 'que', 'V2.0'], lambda t: contains(f, ' ' || trim(regexp_replace(lower(t), '[^a-z0-9+#]+', ' ', 'g')) || ' ')), '|') AS found
FROM (SELECT doc_id, ' ' || regexp_replace(lower(text), '[^a-z0-9+#]+', ' ', 'g') || ' ' AS f FROM documents)
""")
def technology_anchors(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(E.anchored(F.array(*map(F.lit, TECHNOLOGIES)), F.col("text")), "|").alias("found"))


@query("""
SELECT o_orderkey, CAST(CASE k WHEN 0 THEN a + 0.25 WHEN 5 THEN 1000 * (a // 1000 + 1) WHEN 1 THEN a WHEN 2 THEN a WHEN 8 THEN a WHEN 9 THEN a END AS DOUBLE) AS low,
  CAST(CASE k WHEN 0 THEN a + 0.25 WHEN 1 THEN a + 300 WHEN 2 THEN a WHEN 5 THEN 1000 * (a // 1000 + 1) WHEN 8 THEN a + o_custkey % 50 WHEN 9 THEN a + o_custkey % 50 END AS DOUBLE) AS high,
  CASE k WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'NOK' WHEN 5 THEN 'CAD' WHEN 8 THEN 'GBP' WHEN 9 THEN 'EUR' END AS currency,
  CASE k WHEN 0 THEN 'hour' WHEN 1 THEN 'month' WHEN 5 THEN 'year' WHEN 8 THEN 'month' WHEN 9 THEN 'year' END AS period
FROM (SELECT o_orderkey, o_custkey, o_orderkey % 10 AS k, CAST(floor(o_totalprice) AS BIGINT) AS a FROM orders)
""")
def salary_field(spark, sf):
    """Pay strings written from every order's price in ten forms, four of which state no pay."""
    k, a = F.col("o_orderkey") % 10, F.floor("o_totalprice").cast("long")
    high = a + F.col("o_custkey") % 50
    grouped = lambda n, mark: F.regexp_replace(n.cast("string"), r"(\d)(\d{3})$", rf"$1{mark}$2")
    text = (
        F.when(k == 0, F.concat(F.lit("$"), a.cast("string"), F.lit(".25 per hour")))
        .when(k == 1, F.concat(grouped(a, "."), F.lit(" € - "), grouped(a + 300, "."), F.lit(" € monatlich")))
        .when(k == 2, F.concat(F.lit("NOK "), grouped(a, " ")))
        .when(k == 3, F.concat(F.lit("competitive "), "o_orderpriority"))
        .when(k == 4, F.concat(a.cast("string"), F.lit(" - "), (a + 3).cast("string")))
        .when(k == 5, F.concat(F.lit("C$ "), (F.floor(a / 1000) + 1).cast("string"), F.lit("k a year")))
        .when(k == 6, F.concat(F.lit("$2 - $"), (a + 1000).cast("string")))
        .when(k == 8, F.concat(F.lit("£"), a.cast("string"), F.lit(" - £"), high.cast("string"), F.lit(" per month")))
        .when(k == 9, F.concat(F.lit("EUR "), a.cast("string"), F.lit(" - EUR "), high.cast("string"), F.lit(" a year")))
    )
    rows = table(spark, sf, "orders").select("o_orderkey", text.alias("t"))
    return rows.select("o_orderkey", U.field_salary("t").alias("s")).select("o_orderkey", "s.low", "s.high", "s.currency", "s.period")
