"""Record enrichment as Column expressions: dates, slots, declared pay, required languages, cards, anchors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind, first_match, normalize_org, squeeze
from .vocabulary import ASKED, EXPECTED, NAMED, NAMED_ELSEWHERE, NOT_ASKED, PAY_WORDS


def moment(text: Column, now: Column, ahead: str = "2 DAYS") -> Column:
    """Epoch milliseconds, epoch seconds or an ISO date as a timestamp; null where it lies too far ahead of ``now``."""
    number = text.try_cast("double")
    parsed = F.when(number > 1e11, F.timestamp_millis(number.cast("long"))).when(number > 1e8, F.timestamp_seconds(number)).when(number.isNull(), text.try_cast("timestamp"))
    return F.when(parsed <= now + F.expr(f"INTERVAL {ahead}"), parsed)


def unsure_date(text: Column) -> Column:
    """dd/mm/yyyy or mm/dd/yyyy as a date; null where either reading is possible and they differ."""
    part = lambda n: F.nullif(F.regexp_extract(text, r"^\s*(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})\s*$", n), F.lit("")).try_cast("int")
    a, b, y = part(1), part(2), part(3)
    date = lambda d, m: F.concat_ws("-", y.cast("string"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")).try_cast("date")
    return F.when((a > 12) | (a == b), date(a, b)).when(b > 12, date(b, a))


def next_slot(now: Column, zone: Column, hour: Column, every: Column, weekday: Column, monthday: Column) -> Column:
    """The next daily, weekly (ISO weekday) or monthly (day 28 at most) slot at ``hour`` in ``zone``, in UTC."""
    local = F.from_utc_timestamp(now, zone)
    day = F.date_trunc("day", local)
    at = lambda d: d + F.make_dt_interval(hours=hour)
    later = lambda slot, further: F.when(slot > local, slot).otherwise(further)
    daily = later(at(day), at(day + F.expr("INTERVAL 1 DAY")))
    ahead = F.pmod(weekday - F.weekday(local) - 1, F.lit(7))
    this_week = day + F.make_dt_interval(days=ahead)
    weekly = later(at(this_week), at(this_week + F.expr("INTERVAL 7 DAYS")))
    of_month = lambda months: F.date_add(F.add_months(F.trunc(local, "month"), months), (F.least(monthday, F.lit(28)) - 1).cast("int")).cast("timestamp")
    monthly = later(at(of_month(0)), at(of_month(1)))
    return F.to_utc_timestamp(F.when(every == "weekly", weekly).when(every == "monthly", monthly).otherwise(daily), zone)


def domain_country(host: Column) -> Column:
    """Country of a two-letter top-level domain (uk is GB); null for others."""
    ending = F.upper(F.regexp_extract(host, r"\.([a-z]{2})$", 1))
    return F.when(ending == "UK", "GB").when(ending != "", ending)


# Unit words of declared pay.
UNITS = (("year|annu|anno", "year"), ("month|mens|mese", "month"), ("week|settiman", "week"), ("day|giorn|daily", "day"), ("hour|orari|^ora$", "hour"))


def look_up(table: Mapping[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def declared_pay(json: Column, country: Column) -> Column:
    """struct(low, high, currency, period) of a schema.org MonetaryAmount; null if it contradicts its country's currency."""
    get = lambda *paths: F.coalesce(*(F.nullif(F.get_json_object(json, p), F.lit("")) for p in paths))
    plain = lambda t: F.when(t.rlike(r"^\s*\d{1,3}(\.\d{3})+(,\d{1,2})?\s*$"), F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(t, F.lit(","), F.lit("")))
    amount = lambda *paths: bind(F.btrim(plain(get(*paths))).try_cast("double"), lambda v: F.when((v > 0) & (v < 10_000_000), v))
    single = amount("$.value.value", "$.value")
    low, high = F.coalesce(amount("$.value.minValue", "$.minValue"), single), F.coalesce(amount("$.value.maxValue", "$.maxValue"), single)
    stated, expected = F.upper(F.btrim(get("$.currency"))), look_up(EXPECTED, F.upper(country))
    good = (F.coalesce(low, high).isNotNull()) & F.coalesce(stated, expected).isNotNull() & ~F.coalesce(stated != expected, F.lit(False))
    return F.when(good, F.struct(F.coalesce(low, high).alias("low"), F.coalesce(high, low).alias("high"), F.coalesce(stated, expected).alias("currency"), first_match(F.lower(get("$.value.unitText", "$.unitText")), UNITS).alias("period")))


def languages_required(text: Column, most: int = 5) -> Column:
    """Language codes that the clauses of a text require, in its own tongue; clauses that call them optional do not count."""
    names = NAMED | NAMED_ELSEWHERE
    clauses = F.split(F.lower(text), r"[.;\n•]|, (?=but|and a)")
    asked = F.filter(clauses, lambda c: c.rlike("|".join(ASKED)) & ~c.rlike("|".join(NOT_ASKED)))
    found = F.flatten(F.transform(asked, lambda c: F.regexp_extract_all(c, F.lit(r"(?<!\p{L})(" + "|".join(sorted(names, key=lambda n: (-len(n), n))) + r")(?!\p{L})"), F.lit(1))))
    return F.slice(F.array_distinct(F.transform(found, lambda n: look_up(names, n))), 1, most)


# Tags of a listing's detail card.
BENEFITS = (("health insurance|krankenversicherung|mutuelle", "health"), ("pension|401\\(?k|altersvorsorge", "pension"), ("company car|firmenwagen|auto aziendale", "car"), ("meal voucher|buoni pasto|tickets? restaurant", "meals"), ("remote|home ?office|smart ?working", "remote"), ("training|formazione|weiterbildung", "training"))
MANAGEMENT = ((r"(?i)\b(chief|ceo|cto|cfo|coo|president)\b", "executive"), (r"(?i)\b(director|head of|vp)\b", "director"), (r"(?i)\b(manager|lead|supervisor|capo|leiter)\b", "manager"))


def detail_card(title: Column, text: Column) -> Column:
    """management, shifts, weekly hours, urgency, benefit tags and valid-through date of a listing."""
    low = F.lower(text)
    hours = F.nullif(F.regexp_extract(low, r"\b(\d{2})(?:[.,]\d)?\s*(?:hours|ore|stunden|heures)\s*(?:per|a|/|pro|par)?\s*(?:week|settiman|woche|semaine)", 1), F.lit("")).try_cast("int")
    tags = F.array_compact(F.array(*(F.when(low.rlike(p), tag) for p, tag in BENEFITS)))
    return F.struct(
        first_match(title, MANAGEMENT).alias("management"),
        low.rlike(r"\b(night shift|shift work|turni|schicht|3x8|2x8)\b").alias("shifts"),
        F.when((hours >= 4) & (hours <= 60), hours).alias("hours"),
        low.rlike(r"\b(urgent|immediately|asap|ab sofort|urgente|immédiat)\b").alias("urgent"),
        tags.alias("benefits"),
        F.regexp_extract(low, r"(?:apply by|deadline|valid through|entro il)\D{0,12}(\d{4}-\d\d-\d\d)", 1).try_cast("date").alias("valid_through"),
        salary_sentence(text).alias("salary_text"),
        contact_email(text).alias("contact"),
    )


def salary_sentence(text: Column, longest: int = 400) -> Column:
    """The first sentence that has a pay word and an amount of three figures or more beside a currency; null if none."""
    money = r"(?i)(?:[$€£¥]|\b(?:usd|eur|gbp|chf|sek|nok|dkk|pln|czk|huf|cad|aud|inr|brl)\b)[^.\n]{0,40}?[0-9][0-9.,\s]{2,}|[0-9][0-9.,\s]{2,}(?:[$€£]|\b(?:usd|eur|gbp|chf|sek|nok|dkk|pln|czk|k)\b)"
    sentences = F.split(squeeze(text), r"(?<=[.!?])\s+(?=\p{Lu})")
    return F.substring(F.try_element_at(F.filter(sentences, lambda s: s.rlike(money) & s.rlike(rf"(?i)\b(?:{PAY_WORDS})\b")), F.lit(1)), 1, longest)


def microdata(html: Column) -> Column:
    """struct(title, description, company, posted): a page's schema.org JobPosting written as itemprop attributes."""
    prop = lambda name: F.nullif(F.coalesce(F.nullif(F.regexp_extract(html, rf'(?is)<meta[^>]*itemprop="{name}"[^>]*content="([^"]*)"', 1), F.lit("")), squeeze(F.regexp_replace(F.regexp_extract(html, rf'(?is)<(\w+)[^>]*itemprop="{name}"[^>]*>(.*?)</\1\s*>', 2), "<[^>]+>", " "))), F.lit(""))
    whole = F.struct(prop("title").alias("title"), prop("description").alias("description"), prop("hiringOrganization").alias("company"), prop("datePosted").alias("posted"))
    return F.when(html.rlike(r'(?i)itemtype="https?://schema\.org/JobPosting"'), whole)


def dense_paragraphs(html: Column, least: int = 80) -> Column:
    """Paragraphs of a page with at least ``least`` characters of text."""
    blocks = F.split(F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1\s*>", " "), r"(?i)</?(?:p|div|li|td|section|article|br)\b[^>]*>")
    return F.filter(F.transform(blocks, lambda b: squeeze(F.regexp_replace(b, "<[^>]+>", " "))), lambda b: F.length(b) >= least)


def about_sentence(text: Column, name: Column, least: int = 60) -> Column:
    """The first sentence that tells what the named company is: its name and a verb, no role and no second person."""
    sentences = F.split(squeeze(text), r"(?<=[.!?])\s+(?=\p{Lu})")
    verb = r" (is|are|was|offers|develops|builds|provides|designs|è|ist|sind|est)\b"
    good = F.filter(sentences, lambda s: (F.length(s) >= least) & F.startswith(F.concat(normalize_org(s), F.lit(" ")), F.concat(normalize_org(name), F.lit(" "))) & F.lower(s).rlike(verb) & ~F.lower(s).rlike(r"\b(you|your|we are looking|candidate|role|position)\b"))
    return F.try_element_at(good, F.lit(1))


def contact_email(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"\b([\w.+-]+@[\w-]+(?:\.[\w-]+)+)\b", 1), F.lit(""))


def anchored(technologies: Column, text: Column) -> Column:
    """The technologies that a text really names: flattened (letters, digits, + and #) they occur between other signs."""
    flat = lambda t: F.regexp_replace(F.lower(t), r"[^a-z0-9+#]+", " ")
    padded = F.concat(F.lit(" "), flat(text), F.lit(" "))
    return bind(padded, lambda p: F.filter(technologies, lambda t: F.contains(p, F.concat(F.lit(" "), F.btrim(flat(t)), F.lit(" "))) & (F.length(F.btrim(flat(t))) > 0)))


# Legal forms that do not tell companies apart.
LEGAL = "spa|srl|sas|snc|gmbh|ag|kg|se|sa|sarl|ltd|limited|llc|inc|corp|corporation|plc|bv|nv|ab|as|oy|oyj|co"


def registry_key(name: Column) -> Column:
    """A company name without punctuation and legal forms; null if nothing is left."""
    dotless = F.regexp_replace(F.coalesce(name, F.lit("")), r"(?<=\b\p{L})\.(?=\p{L}\b)", "")
    return F.nullif(F.btrim(F.regexp_replace(F.regexp_replace(normalize_org(dotless), rf"\b(?:{LEGAL})\b", " "), r"\s+", " ")), F.lit(""))


def by_prefix(code: Column, table: Mapping[str, str]) -> Column:
    """The value of the longest prefix of ``code`` that the (small) table holds."""
    sizes: Sequence[int] = sorted({len(k) for k in table}, reverse=True)
    return F.coalesce(*(look_up({k: v for k, v in table.items() if len(k) == n}, F.substring(code, 1, n)) for n in sizes))


def register(spark, agency_patterns: Sequence[str] = ()) -> None:
    """The engine's scalar functions as SQL functions of the session."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION normalize_org(name STRING) RETURNS STRING RETURN btrim(regexp_replace(lower(coalesce(name, '')), '[^a-z0-9]+', ' '))")
    pattern = "|".join(agency_patterns) or "(?!)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION classify_employer(name STRING) RETURNS STRING RETURN CASE WHEN btrim(regexp_replace(lower(coalesce(name, '')), '[^a-z0-9]+', ' ')) = '' THEN 'undisclosed' WHEN regexp(btrim(regexp_replace(lower(name), '[^a-z0-9]+', ' ')), '\\\\b(?:{pattern})\\\\b') THEN 'staffing_agency' ELSE 'direct' END")
