"""Text functions as Column expressions: names, addresses, languages, contracts, redaction, HTML."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vocabulary import AGENCIES, BIRTH_LABELS, BOARDS, CONTRACT_KEYS, CONTRACTS, FUNCTION_WORDS, HEADINGS, ID_LABELS, INTERN_CJK, INTERN_STEMS, INTERN_WORDS, LEVELS, MODES, NAMED, PARTICLES, SCRIPTS, STAGE_LANGUAGES, STAGE_WORDS, STREET_ENDINGS, STREETS_AFTER, STREETS_BEFORE, STRONGER, TRACKING


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once for ``body``."""
    return F.transform(F.array(value), body)[0]


def squeeze(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"\s+", " "))


def normalize_org(name: Column) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one blank, trimmed; null as empty."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", " "))


def employer_kind(name: Column, agency_patterns: Sequence[str]) -> Column:
    org = normalize_org(name)
    agency = org.rlike(r"\b(?:" + "|".join(agency_patterns) + r")\b") if agency_patterns else F.lit(False)
    return F.when(org == "", "undisclosed").when(agency, "staffing_agency").otherwise("direct")


def domain(url: Column) -> Column:
    """Host part: scheme and www. dropped, cut at the first of / : ? #, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(url, r"(?i)^(https?://)?(www\.)?", ""), r"[/:?#].*$", ""))


def fold_table() -> tuple[str, str]:
    """Latin letters with a mark and their bare letters, by Unicode decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))) for c in range(0xC0, 0x250)]
    marked = [(a, b[0]) for a, b in pairs if len(b) > 1 and b[0].isascii() and all(unicodedata.combining(x) for x in b[1:])]
    return "".join(a for a, _ in marked), "".join(b for _, b in marked)


def fold(text: Column) -> Column:
    """``text`` without accents on Latin letters."""
    return F.translate(text, *fold_table())


def canonical_url(url: Column) -> Column:
    """One form for all spellings of an address; null where it is no http(s) address.

    Scheme and host in lower case without www., default port, fragment and tracking parameters dropped, the other
    parameters sorted, no slash at the end of a path. An address without a scheme that starts like a host is https.
    """
    raw = F.btrim(url)
    hostlike = r"(?i)^[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z0-9-]+)*\.[a-z]{2,}(?:[:/?#]|$)"
    full = F.when(~raw.contains("://") & raw.rlike(hostlike), F.concat(F.lit("https://"), raw)).otherwise(raw)
    part = lambda n: F.regexp_extract(full, r"(?i)^(https?)://(?:[^/?#@]*@)?([^/?#:]+)(?::(\d*))?([^?#]*)(?:\?([^#]*))?", n)
    scheme, host, port = F.lower(part(1)), F.regexp_replace(F.lower(part(2)), r"^www\.", ""), part(3)
    default = F.when(scheme == "http", "80").otherwise("443")
    path = F.when(part(4) == "", "/").otherwise(part(4))
    path = F.when(F.regexp_replace(path, "/+$", "") == "", "/").otherwise(F.regexp_replace(path, "/+$", ""))
    pairs = F.filter(F.split(part(5), "&"), lambda p: (p != "") & ~F.lower(F.split(p, "=")[0]).isin(*TRACKING))
    whole = F.transform(pairs, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))))
    # sort by (name, value): "=" must sort below every character that a name can hold
    ordered = F.transform(F.array_sort(F.transform(whole, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), p.alias("p")))), lambda x: x["p"])
    query = F.array_join(ordered, "&")
    out = F.concat(scheme, F.lit("://"), host, F.when((port != "") & (port != default), F.concat(F.lit(":"), port)).otherwise(""), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when((scheme != "") & (host != ""), out)


def link_kind(url: Column, agencies: Sequence[str] = AGENCIES, boards: Sequence[str] = BOARDS) -> Column:
    host = domain(url)
    within = lambda names: F.exists(F.array(*map(F.lit, names)), lambda d: (host == d) | host.endswith(F.concat(F.lit("."), d)))
    return F.when(F.coalesce(host, F.lit("")) == "", None).when(within(agencies), "national_agency").when(within(boards), "job_board").otherwise("career_site")


def language_votes(text: Column) -> Column:
    """array of (-votes, place, language, words), most votes first (ties: in the order of the table).

    The words of a text are cut down to function words first; only those are counted language by language.
    """
    every = sorted({w for bag in FUNCTION_WORDS.values() for w in bag})
    words = F.filter(F.split(F.lower(F.regexp_replace(text, "<[^>]+>", " ")), "[^a-zà-ÿåäöøœæčřšž]+"), lambda w: w != "")

    def votes(x: Column) -> Column:
        each = [
            F.struct((-F.size(F.filter(x["known"], lambda w: w.isin(*bag)))).alias("v"), F.lit(i).alias("i"), F.lit(code).alias("code"), x["n"].alias("n"))
            for i, (code, bag) in enumerate(FUNCTION_WORDS.items())
        ]
        return F.array_sort(F.array(*each))

    counted = F.transform(F.array(words), lambda ws: F.struct(F.filter(ws, lambda w: w.isin(*every)).alias("known"), F.size(ws).alias("n")))
    return F.transform(counted, votes)[0]


def by_script(text: Column, otherwise: Column) -> Column:
    """The language of the first letter of a script that only one language has, else ``otherwise``."""
    out = otherwise
    first = F.regexp_extract(F.substring(text, 1, 400), "([가-힯぀-ヿ一-鿿Ѐ-ӿ])", 1)
    for code, letters in reversed(SCRIPTS):
        out = F.when(first.rlike(f"[{letters}]"), code).otherwise(out)
    return out


def clear_winner(votes: Column, n: Column, least_words: int, least_votes: int, lead: float) -> Column:
    """The code with most votes in a sorted array of (-votes, place, code), if words, votes and the lead are enough."""
    clear = (n >= least_words) & (-votes[0]["v"] >= least_votes) & (-votes[0]["v"] >= lead * -votes[1]["v"])
    return F.when(clear, votes[0]["code"])


def language(text: Column, least_words: int = 30, least_votes: int = 5, lead: float = 1.5) -> Column:
    """Language by script, else by function words; null where the text is short or the lead is not clear."""
    return by_script(text, bind(language_votes(text), lambda v: clear_winner(v, v[0]["n"], least_words, least_votes, lead)))


def languages(df: DataFrame, id_column: str, text: str, least_words: int = 30, least_votes: int = 5, lead: float = 1.5) -> DataFrame:
    """(id, language) as ``language`` gives it, for whole tables with one row an id: words are rows, looked up in the table
    of function words by a broadcast join and counted in compiled code, a bit for each language."""
    masks: dict[str, int] = {}
    for i, bag in enumerate(FUNCTION_WORDS.values()):
        for word in bag:
            masks[word] = masks.get(word, 0) | 1 << i
    table = F.broadcast(df.sparkSession.createDataFrame(sorted(masks.items()), "word string, mask int"))
    plain = F.lower(F.regexp_replace(F.col(text), "<[^>]+>", " "))
    words = df.select(F.col(id_column).alias("__id"), F.explode(F.split(plain, "[^a-zà-ÿåäöøœæčřšž]+")).alias("word")).where("word <> ''")
    counted = words.join(table, "word", "left").groupBy("__id").agg(F.count("*").alias("n"), *(F.count_if(F.col("mask").bitwiseAND(1 << i) != 0).alias(code) for i, code in enumerate(FUNCTION_WORDS)))
    votes = F.array_sort(F.array(*(F.struct((-F.col(code)).alias("v"), F.lit(i).alias("i"), F.lit(code).alias("code")) for i, code in enumerate(FUNCTION_WORDS))))
    winners = counted.select("__id", bind(votes, lambda v: clear_winner(v, F.col("n"), least_words, least_votes, lead)).alias("__code"))
    return df.select(id_column, text).join(winners, F.col(id_column) == F.col("__id"), "left").select(id_column, by_script(F.col(text), F.col("__code")).alias("language"))


def required_language(text: Column) -> Column:
    """The language code an English text asks for, else null.

    The first name of a language that has a word of command within three words before it, or one of need right after it.
    """
    command, need = ("fluent", "native", "professional", "businesslevel"), ("required", "mandatory", "essential", "must")
    low = F.regexp_replace(F.lower(text), "business[- ]level", "businesslevel")
    words = F.filter(F.split(low, r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def asked(ws: Column) -> Column:
        commands = lambda w: w.isin(*command) | w.startswith("proficien")
        # what follows a name, without words that may stand between
        after = lambda i: F.filter(F.slice(ws, i + 2, 4), lambda w: ~w.isin("language", "is", "a"))
        hit = lambda w, i: w.isin(*NAMED) & (F.exists(F.slice(ws, F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3))), commands) | F.coalesce(F.try_element_at(after(i), F.lit(1)).isin(*need), F.lit(False)))
        return F.try_element_at(F.array_compact(F.transform(ws, lambda w, i: F.when(hit(w, i), w))), F.lit(1))

    return F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])[F.transform(F.array(words), asked)[0]]


def first_match(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The value of the first rule whose pattern is found in ``text``; null if none is."""
    out = F.lit(None).cast("string")
    for pattern, value in reversed(rules):
        out = F.when(text.rlike(pattern), value).otherwise(out)
    return out


def contract(value: Column) -> Column:
    """The kind of contract whose words a value holds, the earlier kind of the table on several; null if none."""
    said = F.concat(F.lower(F.translate(value, "_-", "  ")), F.lit(" "))
    table = F.array(*(F.struct(F.lit(part).alias("part"), F.lit(kind).alias("kind")) for kind, parts in CONTRACTS for part in parts))
    return bind(said, lambda v: F.try_element_at(F.filter(table, lambda r: F.contains(v, r["part"])), F.lit(1))["kind"])


def contract_of(json: Column) -> Column:
    """The contract of a listing's JSON: of all known keys that tell one, a stronger kind wins, else the first key."""
    values = lambda j: F.array(*(F.coalesce(F.get_json_object(j, f"$.{k}.label"), F.get_json_object(j, f"$.{k}")) for k in CONTRACT_KEYS))
    # the JSON is made once, not again for each key
    found = F.array_compact(F.transform(F.filter(bind(json, values), lambda v: v.isNotNull()), contract))
    return bind(found, lambda kinds: F.coalesce(*(F.when(F.array_contains(kinds, kind), kind) for kind in STRONGER), F.try_element_at(kinds, F.lit(1))))


def level(title: Column) -> Column:
    return first_match(title, LEVELS)


def work_mode(text: Column) -> Column:
    return first_match(text, MODES)


def skills_in(text: Column, skills: Sequence[str], most: int = 20) -> Column:
    """The ``skills`` that occur in ``text`` as whole words, in the order given, at most ``most``."""
    def pattern(skill: str) -> str:
        body = r"\s+".join("".join("\\" + c if not c.isalnum() else c for c in w) for w in skill.split(" "))
        return rf"(?i)(?<![\p{{L}}\p{{N}}]){body}(?![\p{{L}}\p{{N}}])"

    found = F.array(*(F.when(text.rlike(pattern(s)), s) for s in skills))
    return F.slice(F.array_compact(found), 1, most)


def clean_skills(values: Column, unwanted: Sequence[str] = (), most: int = 20) -> Column:
    """Skills without a parenthesis at the end, blank or unwanted ones; the first of each spelling, at most ``most``."""
    bare = F.transform(values, lambda v: F.btrim(F.regexp_replace(F.btrim(v), r"\s*\([^)]*\)\s*$", "")))
    good = F.filter(bare, lambda v: (F.length(v) >= 2) & ~F.lower(v).isin("", *unwanted))
    first = F.filter(F.transform(good, lambda v, i: F.struct(v.alias("v"), i.alias("i"))), lambda x: F.array_position(F.transform(good, lambda y: F.lower(y)), F.lower(x["v"])) == x["i"] + 1)
    kept = F.transform(first, lambda x: F.when((x["v"] == F.upper(x["v"])) | F.substring(x["v"], 2, 1000).rlike("[A-Z]"), x["v"]).otherwise(F.lower(x["v"])))
    return F.slice(kept, 1, most)


def any_of(words: Sequence[str]) -> str:
    """Alternatives of a pattern, longest first, each taken as it is."""
    return "|".join("".join(c if c.isalnum() or c == " " else "\\" + c for c in w) for w in sorted(words, key=lambda w: (-len(w), w)))


#: Particles, then one to three capitalised words ("des Lilas", "dell'Orso Verde").
STREET_NAME = rf"(?: (?:{any_of(PARTICLES)}))*(?: (?:\p{{L}}{{1,4}}['’])?\p{{Lu}}[\p{{L}}'’.-]*){{1,3}}"
#: Marks and what they replace, in this order: what a label or a street's word announces goes before bare numbers. Each
#: pattern begins after the text's start or a character that is no letter or digit, which stays.
REDACTIONS = (
    ("BIRTH", rf"(?i:{any_of(BIRTH_LABELS)})[\t :.-]{{0,3}}[0-9]{{1,4}}[ \t./-](?:[0-9]{{1,2}}|\p{{L}}{{3,9}})[ \t./-][0-9]{{2,4}}"),
    ("ID", r"[A-Z]{6}[0-9]{2}[A-Z][0-9]{2}[A-Z][0-9]{3}[A-Z]"),
    ("ID", rf"(?i:{any_of(ID_LABELS)})[\t :.#-]{{1,3}}[A-Z0-9](?:[ \t./-]?[A-Z0-9]){{5,20}}"),
    ("ID", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"),
    ("ADDRESS", rf"[0-9]{{1,4}},? (?i:{any_of(STREETS_BEFORE)}){STREET_NAME}"),
    ("ADDRESS", rf"(?i:{any_of(STREETS_BEFORE)}){STREET_NAME},? [0-9]{{1,4}}[a-zA-Z]?"),
    ("ADDRESS", rf"[0-9]{{1,4}}[a-zA-Z]? (?:\p{{Lu}}[\p{{L}}'’-]* ){{1,3}}(?i:{any_of(STREETS_AFTER)})"),
    ("ADDRESS", rf"\p{{Lu}}[\p{{L}}-]*(?:{any_of(STREET_ENDINGS)}) [0-9]{{1,4}}[a-zA-Z]?"),
    ("ADDRESS", r"(?:[0-9]{5}|(?:1[0-8]|2[1-9]|[3-9][0-9])[0-9]{2} ?[A-Z]{2}|[A-Z]{1,2}[0-9]{1,2}[A-Z]? [0-9][A-Z]{2}) \p{Lu}\p{L}+(?: \p{Lu}\p{L}+)?"),
    ("LINK", r"(?i:https?://|www\.|(?:linkedin|github|gitlab|xing)\.com/)[^\s<>\"]+"),
    ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("PHONE", r"(?:\+|00)[0-9]{1,3}(?:[ \t./()-]{0,3}[0-9]){6,12}"),
    ("PHONE", r"0[0-9]{1,3}(?:[ \t./-]?[0-9]){6,11}"),
)
#: What no pattern of the kind can match without: lines without it are not searched. An ID behind a label may be all letters.
NEEDED = {"BIRTH": "[0-9]", "ID": r"[A-Z0-9](?:[ \t./-]?[A-Z0-9]){5}", "ADDRESS": "[0-9]", "LINK": "[.:]", "EMAIL": "@", "PHONE": "[0-9]"}
#: What no pattern at all can match without.
REDACTABLE = r"[0-9@/]|(?i:www\.)|[A-Z][ \t./-]?[A-Z]"


def redact(text: Column) -> Column:
    """``text`` with personal data replaced by typed marks such as [EMAIL].

    No pattern goes across a line's end, so lines are searched one by one, and most have nothing to look for.
    """
    def step(mark: str, pattern: str):
        return lambda t: F.when(t.rlike(NEEDED[mark]), F.regexp_replace(t, r"(^|[^\p{L}\p{N}])(?:" + pattern + ")", rf"$1[{mark}]")).otherwise(t)

    def line(t: Column) -> Column:
        found = t
        for mark, pattern in REDACTIONS:
            found = bind(found, step(mark, pattern))
        return F.when(t.rlike(REDACTABLE), found).otherwise(t)

    return F.array_join(F.transform(F.split(text, "\n"), line), "\n")


def head_name(text: Column) -> Column:
    """The name on top of a CV: the first of twelve lines with two to four words, two of them at least capitalised, the
    others particles, none of a heading; null if there is none."""
    word = r"\p{Lu}[\p{L}'’-]*[.,]?"
    shape = rf"^{word}(?: (?:{word}|(?:{any_of(PARTICLES)}))){{0,2}} {word}$"
    heading = rf"(?i)(?:^| )(?:{any_of(HEADINGS)})(?:[.,]|$| )"
    lines = F.transform(F.slice(F.split(text, r"\r?\n"), 1, 12), lambda x: squeeze(F.btrim(x, F.lit(" \t|·•-–—:"))))
    return F.try_element_at(F.filter(lines, lambda x: (F.length(x) <= 60) & x.rlike(shape) & ~x.rlike(heading)), F.lit(1))


def redact_name(text: Column, name: Column) -> Column:
    """``text`` with [CANDIDATE] for the name and for each of its words of three letters or more; neighbours merge."""
    pieces = F.filter(F.array_distinct(F.concat(F.array(F.btrim(name, F.lit(".,"))), F.transform(F.split(name, " "), lambda w: F.btrim(w, F.lit(".,"))))), lambda w: F.length(w) >= 3)
    gone = F.aggregate(pieces, text, lambda t, w: F.regexp_replace(t, F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), w, F.lit(r"\E(?![\p{L}\p{N}])")), F.lit("[CANDIDATE]")))
    merged = F.regexp_replace(gone, r"(?:\[CANDIDATE\][ \t]*){2,}", "[CANDIDATE] ")
    return F.when(name.isNull(), text).otherwise(merged)


def html_title(html: Column) -> Column:
    return F.btrim(F.regexp_extract(html, r"(?is)<title[^>]*>([^<]*)</title>", 1))


def html_links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1))


#: Elements that stand on lines of their own.
BLOCKS = ("p", "div", "br", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "section", "article", "header", "footer", "blockquote", "pre")
#: A page's pieces: what is never shown, a tag, a stretch of text, or a stray "<" that is text.
PIECES = r"(?is)<!--.*?-->|<(?:script)\b.*?</script\s*>|<(?:style)\b.*?</style\s*>|<(?:noscript)\b.*?</noscript\s*>|<[^>]+>|[^<]+|<"


def html_text(html: Column) -> Column:
    """Plain text of a page whose entities are decoded: one pass over its pieces, each giving its text or a gap.

    Blocks begin and end lines, list items begin a line with a dash, all other tags part words; blanks are single and
    there is never more than one empty line.
    """
    def shown(piece: Column) -> Column:
        tag = F.lower(F.regexp_extract(piece, r"^<\s*(/?\s*[a-zA-Z][a-zA-Z0-9]*)[^>]*>", 1))
        name = F.ltrim(tag, F.lit("/ "))
        gap = F.when(tag == "li", "\n- ").when(name == "li", "").when(name.isin(*BLOCKS), "\n").otherwise(" ")
        return F.when(F.startswith(piece, F.lit("<")) & (F.length(piece) > 1), gap).otherwise(F.translate(piece, "\u00a0\u200b", " "))

    joined = F.array_join(F.transform(F.regexp_extract_all(html, F.lit(PIECES), F.lit(0)), shown), "")
    lines = F.transform(F.split(joined, "\n"), lambda x: F.btrim(F.regexp_replace(x, r"[ \t\r\f\x0b]+", " "), F.lit(" ")))
    return F.btrim(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"), F.lit(" \n"))


def json_ld(html: Column) -> Column:
    """The ld+json blocks of a page, as strings."""
    return F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*ld\+json[^>]*>(.*?)</script>"), F.lit(1)), lambda x: F.btrim(x, F.lit(" \t\r\n")))


def job_posting(html: Column) -> Column:
    """The first valid ld+json object of type JobPosting (alone, in a list or in @graph), as JSON; null if none."""
    whole = F.filter(json_ld(html), lambda b: F.try_parse_json(b).isNotNull())
    listed = F.flatten(F.transform(whole, lambda b: F.coalesce(F.from_json(b, "array<string>"), F.from_json(F.get_json_object(b, "$['@graph']"), "array<string>"), F.array(b))))
    return F.try_element_at(F.filter(listed, lambda b: F.get_json_object(b, "$['@type']") == "JobPosting"), F.lit(1))


def numbers_grounded(summary: Column, source: Column, least_words: int = 0) -> Column:
    """Sentences of ``summary`` whose numbers of three digits or more all occur in ``source``, joined; null if fewer than
    ``least_words`` words are left."""
    sentences = F.split(summary, r"(?<=[.!?])\s+")
    digits = lambda t: F.transform(F.regexp_extract_all(t, F.lit(r"(\d[\d.,]*\d{2,}|\d{3,})"), F.lit(1)), lambda n: F.regexp_replace(n, "[.,]", ""))
    # the source's numbers are found once, not again for each sentence; most sentences have none to look for
    grounded = lambda known: F.filter(sentences, lambda s: F.when(s.rlike("[0-9]"), F.size(F.array_except(digits(s), known)) == 0).otherwise(F.lit(True)))
    kept = F.array_join(bind(digits(source), grounded), " ")
    return bind(kept, lambda t: F.when(F.size(F.filter(F.split(t, r"\s+"), lambda w: w != "")) >= least_words, t)) if least_words else kept


INTERN_SAID = "|".join([any_of(INTERN_WORDS), *(stem + r"\w*" for stem in INTERN_STEMS)])


def internship_evidence(title: Column, text: Column, lang: Column | None = None, said: str = INTERN_SAID, cjk: Sequence[str] = INTERN_CJK, stage: Sequence[str] = STAGE_WORDS, apart: str = r"(?i)(?<![a-zÀ-ɏ])(?:{})(?![a-zÀ-ɏ])") -> Column:
    """One word for an internship in the title, or two in the text. ``stage`` are words that say it in some languages only;
    ``apart`` is how ``said`` and they must stand."""
    local = F.coalesce(lang.isin(*STAGE_LANGUAGES), F.lit(False)) if lang is not None else F.lit(False)

    def times(part: Column) -> Column:
        part = F.coalesce(part, F.lit(""))
        n = F.regexp_count(part, F.lit(apart.format(said)))
        n = n + F.regexp_count(part, F.lit("|".join(cjk))) if cjk else n
        return n + F.when(local, F.regexp_count(part, F.lit(apart.format(any_of(stage))))).otherwise(0)

    return (times(title) >= 1) | (times(text) >= 2)


def headcounts(text: Column, low: int = 10, high: int = 3_000_000) -> Column:
    """Head counts a text states ("1.200 employees"), without years after "in", "since" and the like."""
    stated = F.regexp_extract_all(F.regexp_replace(text, r"(?i)\b(?:in|since|dal|nel|seit|depuis|desde|founded)\s+(?:19[9]\d|20[0-2]\d|203[0-5])\b", " "), F.lit(r"(?i)(\d[\d.,]*)\+?\s+(?:employees|people|dipendenti|mitarbeiter|collaborateurs|empleados|medewerkers)"), F.lit(1))
    return F.filter(F.transform(stated, lambda n: F.regexp_replace(n, "[.,]", "").try_cast("long")), lambda n: (n >= low) & (n <= high))


BANDS = ((10, "1-10"), (50, "11-50"), (200, "51-200"), (500, "201-500"), (1000, "501-1000"), (5000, "1001-5000"), (10000, "5001-10000"))


def size_band(n: Column) -> Column:
    out = F.when(n > BANDS[-1][0], "10001+")
    for high, name in reversed(BANDS):
        out = F.when(n <= high, name).otherwise(out)
    return F.when(n > 0, out)


def headcount(sources: Sequence[tuple[str, Column]], band: Column) -> tuple[Column, Column, Column]:
    """(number, its source, band): the first positive source; the stated band only where there is no number."""
    number = F.coalesce(*(F.when(c > 0, c) for _, c in sources))
    origin = F.coalesce(*(F.when(c > 0, name) for name, c in sources))
    return number, origin, F.coalesce(size_band(number), band)


def iso_week(time: Column) -> Column:
    return F.concat(F.date_part(F.lit("YEAROFWEEK"), time).cast("string"), F.lit("-"), F.lpad(F.weekofyear(time).cast("string"), 2, "0"))


def fingerprint(organization: Column, title: Column, country: Column, city: Column, posted: Column) -> Column:
    """sha256 over the normalised employer, title, first country, first city and ISO week."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    parts = [F.lower(squeeze(empty(organization))), F.lower(squeeze(empty(title))), empty(country), F.lower(empty(city)), empty(iso_week(posted))]
    return F.sha2(F.concat_ws("|", *parts), 256)
