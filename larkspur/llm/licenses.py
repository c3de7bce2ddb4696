"""License scan by ordered signature rules, in Catalyst expressions only.

A text is its words (letters, digits and non-ASCII characters, A-Z lower-cased). A rule is a pattern over neighbouring
words, known by one of its words, its keyword. The scan

1. finds the places of keywords and takes the few words around each, so no rule ever sees a whole text;
2. joins these places with the rules of the keyword, tests the rule's second keyword, then the pattern at that place;
3. suppresses a detection that lies within another one of higher priority, or within a longer one of the same; of equal
   ones the earlier rule stays.

Priorities, from the top: tags, sentences of license texts, grants ("licensed under ..."), full names, short names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .quality import let
from .runtime import Scratch, stored

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words before a keyword that a rule may start with, and words of a place in all; no pattern is longer.
BACK, SPAN = 2, 32
SHORT, NAME, GRANT, SENTENCE, TAG = range(1, 6)
WEIGHTS = {SHORT: 0.5, NAME: 0.75, GRANT: 0.9, SENTENCE: 0.95, TAG: 1.0}
BASE_WEIGHT = 0.8

#: (label, keyword, words before it, second keyword, words) of the phrases that always count.
PHRASES = (("mit", "mit", 2, "license", "under the mit license"), ("apache-2", "apache", 0, "license", "apache license version 2"), ("cc-by-nc", "cc", 0, "by nc", "cc by nc"))

V = "(?:version |v ?|ver )?"  # before a number
LIC = "licen[sc]es?"
CC = f"(?:cc|creative commons(?: {LIC})?) "
ATTRIBUTION = "creative commons attribution"
INT = "(?: international| unported| generic)?"

#: (label, priority of the name by itself, second keyword, keywords, pattern), of names that may stand in a grant.
NAMES = (
    ("0bsd", NAME, "bsd", "zero bsd0", f"(?:zero clause bsd|bsd0)(?: {LIC})?"),
    ("afl-3", NAME, "academic", "academic", f"academic free {LIC} {V}3(?: 0)?"),
    ("afl", SHORT, "academic", "academic", f"academic free {LIC}"),
    ("agpl-3", NAME, "agpl", "agpl agplv3", f"(?:agpl {V}3|agplv3)(?: 0)?(?: only| or later)?"),
    ("agpl-3", NAME, "affero", "gnu affero", f"(?:gnu )?affero general public {LIC} {V}3(?: 0)?"),
    ("agpl", SHORT, "agpl", "agpl", f"agpl(?: {LIC})?"),
    ("agpl", SHORT, "affero", "gnu affero", f"(?:gnu )?affero general public {LIC}"),
    ("apache-1", NAME, "apache", "apache", f"apache (?:software )?(?:{LIC} )?{V}1(?: [01])?"),
    ("apache-2", NAME, "apache", "apache", f"apache (?:software )?(?:{LIC} )?{V}2(?: 0)?(?: {LIC})?"),
    ("apache-2", NAME, "apache2", "apache2", f"apache2(?: 0)?(?: {LIC})?"),
    ("apache", SHORT, "apache", "apache", f"apache (?:software )?{LIC}"),
    ("artistic-1", NAME, "artistic", "artistic perl", f"(?:perl )?artistic {LIC} {V}1(?: 0)?"),
    ("artistic-2", NAME, "artistic", "artistic", f"artistic {LIC} {V}2(?: 0)?"),
    ("artistic", SHORT, "artistic", "artistic", f"artistic {LIC}"),
    ("beerware", NAME, "beer", "beerware beer", f"(?:beerware|beer ware)(?: {LIC})?"),
    ("blueoak-1", NAME, "blue", "blue", f"blue oak model {LIC}(?: {V}1(?: 0 0)?)?"),
    ("bsd-2-clause", NAME, "clause", "bsd", f"bsd 2 clause(?: {LIC})?"),
    ("bsd-2-clause", NAME, "bsd", "2 two simplified freebsd", f"(?:2 clause|two clause|simplified) bsd(?: {LIC})?"),
    ("bsd-2-clause", NAME, "freebsd", "freebsd", f"freebsd {LIC}"),
    ("bsd-3-clause", NAME, "clause", "bsd", f"bsd 3 clause(?: {LIC})?"),
    ("bsd-3-clause", NAME, "bsd", "3 three new modified revised", f"(?:3 clause|three clause|new|modified|revised) bsd(?: {LIC})?"),
    ("bsd-4-clause", NAME, "clause", "bsd", f"bsd 4 clause(?: {LIC})?"),
    ("bsd-4-clause", NAME, "bsd", "4 four original", f"(?:4 clause|four clause|original) bsd(?: {LIC})?"),
    ("bsd", SHORT, "licen", "bsd", f"bsd(?: style)? {LIC}"),
    ("bsl-1", NAME, "boost", "boost", f"boost software {LIC}(?: {V}1(?: 0)?)?"),
    ("busl-1.1", NAME, "business", "business", f"business source {LIC}(?: {V}1 1)?"),
    ("cc0", NAME, "cc0", "cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("cc0", NAME, "zero", "creative", f"creative commons zero(?: {V}1 0)?(?: universal)?"),
    ("cc-by", NAME, "by", "cc creative", f"{CC}by(?: [1-4] [05])?{INT}"),
    ("cc-by", NAME, "attribution", "creative", f"{ATTRIBUTION}(?: {V}[1-4] [05])?{INT}(?: {LIC})?"),
    ("cc-by-sa", NAME, "by", "cc creative", f"{CC}by sa(?: [1-4] [05])?{INT}"),
    ("cc-by-sa", NAME, "attribution", "creative", f"{ATTRIBUTION} share ?alike(?: {V}[1-4] [05])?{INT}(?: {LIC})?"),
    ("cc-by-nd", NAME, "by", "cc creative", f"{CC}by nd(?: [1-4] [05])?{INT}"),
    ("cc-by-nd", NAME, "attribution", "creative", f"{ATTRIBUTION} no ?deriv(?:ative|atives|s)?(?: works)?(?: {V}[1-4] [05])?{INT}(?: {LIC})?"),
    ("cc-by-nc", NAME, "by", "cc creative", f"{CC}by nc(?: [1-4] [05])?{INT}"),
    ("cc-by-nc", NAME, "attribution", "creative", f"{ATTRIBUTION} non ?commercial(?: {V}[1-4] [05])?{INT}(?: {LIC})?"),
    ("cc-by-nc-sa", NAME, "by", "cc creative", f"{CC}by nc sa(?: [1-4] [05])?{INT}"),
    ("cc-by-nc-sa", NAME, "attribution", "creative", f"{ATTRIBUTION} non ?commercial share ?alike(?: {V}[1-4] [05])?{INT}(?: {LIC})?"),
    ("cc-by-nc-nd", NAME, "by", "cc creative", f"{CC}by nc nd(?: [1-4] [05])?{INT}"),
    ("cc-by-nc-nd", NAME, "attribution", "creative", f"{ATTRIBUTION} non ?commercial no ?deriv(?:ative|atives|s)?(?: works)?(?: {V}[1-4] [05])?{INT}(?: {LIC})?"),
    ("cc", SHORT, "commons", "creative", f"creative commons {LIC}"),
    ("cddl-1", NAME, "cddl", "cddl", f"cddl(?: {V}1(?: [01])?)?"),
    ("cddl-1", NAME, "common", "common", f"common development and distribution {LIC}(?: {V}1(?: [01])?)?"),
    ("cecill-2", NAME, "cecill", "cecill", f"cecill(?: [bc])?(?: {LIC})?(?: {V}2(?: [01])?)?"),
    ("cpl-1", NAME, "common", "common", f"common public {LIC}(?: {V}1(?: 0)?)?"),
    ("ecl-2", NAME, "educational", "educational", f"educational community {LIC}(?: {V}2(?: 0)?)?"),
    ("elastic-2", NAME, "elastic", "elastic", f"elastic {LIC}(?: {V}2(?: 0)?)?"),
    ("epl-1", NAME, "eclipse", "eclipse", f"eclipse (?:public )?{LIC} {V}1(?: 0)?"),
    ("epl-2", NAME, "eclipse", "eclipse", f"eclipse (?:public )?{LIC} {V}2(?: 0)?"),
    ("epl", SHORT, "eclipse", "eclipse", f"eclipse public {LIC}"),
    ("eupl", NAME, "european", "european", f"european union public {LIC}(?: {V}1(?: [12])?)?"),
    ("fdl-1", NAME, "gnu", "gnu", f"gnu free documentation {LIC}(?: {V}1(?: [123])?)?"),
    ("gpl-2", NAME, "gpl", "gpl", f"gpl {V}2(?: 0)?(?: only| or later)?"),
    ("gpl-2", NAME, "gplv2", "gplv2", "gplv2(?: 0)?(?: only| or later)?"),
    ("gpl-2", NAME, "general", "gnu general", f"(?:gnu )?general public {LIC} {V}2(?: 0)?(?: only| or (?:any )?later(?: version)?)?"),
    ("gpl-3", NAME, "gpl", "gpl", f"gpl {V}3(?: 0)?(?: only| or later)?"),
    ("gpl-3", NAME, "gplv3", "gplv3", "gplv3(?: 0)?(?: only| or later)?"),
    ("gpl-3", NAME, "general", "gnu general", f"(?:gnu )?general public {LIC} {V}3(?: 0)?(?: only| or (?:any )?later(?: version)?)?"),
    ("gpl", SHORT, "gpl", "gpl", f"gpl(?: {LIC})?"),
    ("gpl", SHORT, "gnu", "gnu", f"gnu general public {LIC}"),
    ("hpnd", NAME, "historical", "historical", "historical permission notice and disclaimer"),
    ("isc", NAME, "licen", "isc", f"isc {LIC}"),
    ("lgpl-2", NAME, "lgpl", "lgpl lgplv2", f"(?:lgpl {V}2|lgplv2)(?: [01])?(?: only| or later)?"),
    ("lgpl-2", NAME, "general", "gnu lesser library", f"(?:gnu )?(?:lesser|library) general public {LIC} {V}2(?: [01])?"),
    ("lgpl-3", NAME, "lgpl", "lgpl lgplv3", f"(?:lgpl {V}3|lgplv3)(?: 0)?(?: only| or later)?"),
    ("lgpl-3", NAME, "general", "gnu lesser", f"(?:gnu )?lesser general public {LIC} {V}3(?: 0)?"),
    ("lgpl", SHORT, "lgpl", "lgpl", f"lgpl(?: {LIC})?"),
    ("lgpl", SHORT, "general", "gnu lesser", f"(?:gnu )?lesser general public {LIC}"),
    ("lppl", NAME, "latex", "latex", f"latex project public {LIC}(?: {V}1(?: [0-3]c?)?)?"),
    ("mit", NAME, "licen", "mit expat x11", f"(?:mit(?: x11| expat| style)?|expat|x11) {LIC}"),
    ("mit-0", NAME, "attribution", "mit", f"mit no attribution(?: {LIC})?"),
    ("mpl-1", NAME, "mozilla", "mozilla", f"mozilla public {LIC} {V}1(?: [01])?"),
    ("mpl-2", NAME, "mozilla", "mozilla", f"mozilla public {LIC} {V}2(?: 0)?"),
    ("mpl-2", NAME, "mpl", "mpl mplv2", f"(?:mpl {V}2|mplv2)(?: 0)?"),
    ("mpl", SHORT, "mozilla", "mozilla", f"mozilla public {LIC}"),
    ("ms-pl", NAME, "microsoft", "microsoft", f"microsoft public {LIC}"),
    ("ms-rl", NAME, "microsoft", "microsoft", f"microsoft reciprocal {LIC}"),
    ("ncsa", NAME, "illinois", "university ncsa", f"(?:university of )?illinois(?: ncsa)? open source {LIC}"),
    ("odbl-1", NAME, "open", "open", f"open (?:data commons open )?database {LIC}(?: {V}1(?: 0)?)?"),
    ("ofl-1.1", NAME, "sil", "sil", f"sil open font {LIC}(?: {V}1 1)?"),
    ("openssl", NAME, "openssl", "openssl", f"openssl {LIC}"),
    ("osl-3", NAME, "open", "open", f"open software {LIC}(?: {V}3(?: 0)?)?"),
    ("php-3", NAME, "php", "php", f"php {LIC}(?: {V}3(?: 01?)?)?"),
    ("postgresql", NAME, "postgresql", "postgresql", f"postgresql {LIC}"),
    ("public-domain", NAME, "domain", "public", "public domain"),
    ("python-2", NAME, "python", "python psf", f"(?:python software foundation|psf|python) {LIC}(?: {V}2(?: 0)?)?"),
    ("qpl-1", NAME, "q", "q", f"q public {LIC}(?: {V}1(?: 0)?)?"),
    ("ruby", NAME, "ruby", "ruby", f"ruby {LIC}"),
    ("sspl-1", NAME, "server", "server", f"server side public {LIC}(?: {V}1(?: 0)?)?"),
    ("unicode", NAME, "unicode", "unicode", f"unicode {LIC}(?: {V}3)?"),
    ("unlicense", NAME, "unlicense", "unlicense", "unlicense"),
    ("upl-1", NAME, "universal", "universal", f"universal permissive {LIC}(?: {V}1(?: 0)?)?"),
    ("vim", NAME, "vim", "vim", f"vim {LIC}"),
    ("wtfpl", NAME, "wtfpl", "wtfpl", "wtfpl(?: 2)?"),
    ("zlib", NAME, "zlib", "zlib", f"zlib(?: libpng)? {LIC}"),
    ("zpl-2", NAME, "zope", "zope", f"zope public {LIC}(?: {V}2(?: [01])?)?"),
)

#: (label, second keyword, keyword, pattern) of sentences that stand in a license's own text or notice.
SENTENCES = (
    ("mit", "free of charge", "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "substantial portions", "above", "above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "noninfringement", "warranties", "warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders"),
    ("bsl-1", "organization", "permission", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("bsd", "binary forms", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse", "neither", r"neither the names? of (?:[^ ]+ ){1,8}?nor the names of (?:its|the|any|other) (?:[^ ]+ ){0,2}?may be used to endorse or promote products"),
    ("bsd-4-clause", "acknowledg", "advertising", "advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("isc", "hereby granted", "permission", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("0bsd", "hereby granted", "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("apache-2", "apache", "licensed", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2", "apache org", "may", r"may obtain a copy of the license at https? (?:www )?apache org licenses license 2 0"),
    ("apache-2", "apache org", "apache", "apache org licenses license 2 0(?: txt| html)?"),
    ("apache-2", "except in compliance", "licensed", "licensed under the apache license version 2 0 the license you may not use this (?:file|work) except in compliance"),
    ("gpl", "gnu general", "free", "free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-2", "either version 2", "foundation", "foundation either version 2 of the license or at your option any later version"),
    ("gpl-3", "either version 3", "foundation", "foundation either version 3 of the license or at your option any later version"),
    ("lgpl", "lesser", "modify", "modify it under the terms of the gnu (?:lesser|library) general public license as published by the free software foundation"),
    ("agpl", "affero", "modify", "modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("gpl", "gnu org", "gnu", "gnu org licenses(?: old licenses)? gpl(?: 2 0| 3 0)?(?: html| txt)?"),
    ("lgpl", "gnu org", "gnu", "gnu org licenses(?: old licenses)? lgpl(?: 2 1| 3 0)?(?: html| txt)?"),
    ("mpl-2", "mozilla", "source", "source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1", "mozilla", "contents", r"contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2", "mozilla org", "mozilla", "mozilla org mpl 2 0"),
    ("epl-2", "eclipse", "accompanying", "accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("epl-1", "eclipse", "accompanying", "accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("unlicense", "unencumbered", "free", "free and unencumbered software released into the public domain"),
    ("unlicense", "unlicense", "unlicense", "unlicense org"),
    ("cc0", "dedicated", "dedicated", "dedicated the work to the public domain by waiving all of his or her rights"),
    ("cc0", "publicdomain", "creativecommons", "creativecommons org publicdomain zero 1 0"),
    ("cc-by", "licenses by", "creativecommons", "creativecommons org licenses by [1-4] [05]"),
    ("cc-by-sa", "licenses by", "creativecommons", "creativecommons org licenses by sa [1-4] [05]"),
    ("cc-by-nd", "licenses by", "creativecommons", "creativecommons org licenses by nd [1-4] [05]"),
    ("cc-by-nc", "licenses by", "creativecommons", "creativecommons org licenses by nc [1-4] [05]"),
    ("cc-by-nc-sa", "licenses by", "creativecommons", "creativecommons org licenses by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", "licenses by", "creativecommons", "creativecommons org licenses by nc nd [1-4] [05]"),
    ("zlib", "misrepresented", "origin", "origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "held liable", "express", "express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("wtfpl", "want to", "what", "what the fuck you want to public license"),
    ("beerware", "beer", "buy", "buy me a beer in return"),
    ("ofl-1.1", "font software", "permission", "permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    ("hpnd", "hereby granted", "permission", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("postgresql", "written agreement", "documentation", "documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("ncsa", "deal with", "deal", "deal with the software without restriction including without limitation the rights"),
    ("artistic-2", "copyright holder", "everyone", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed this license establishes"),
    ("gpl", "verbatim copies", "everyone", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble"),
    ("cddl-1", "common development", "contents", "contents of this file are subject to the terms of (?:either )?the common development and distribution license"),
    ("ms-pl", "accept", "governs", "governs use of the accompanying software if you use the software you accept this license"),
    ("odbl-1", "opendatacommons", "opendatacommons", "opendatacommons org licenses odbl"),
    ("proprietary", "confidential", "proprietary", "proprietary and confidential"),
    ("proprietary", "prohibited", "unauthorized", r"unauthori[sz]ed copying of this file via any medium is strictly prohibited"),
)

#: Identifiers that may follow a tag, as words, with the label each one gives.
IDENTIFIERS = (
    ("0bsd", "0bsd"), ("afl-3", "afl 3 0"), ("agpl-3", "agpl 3 0"), ("apache-1", "apache 1 [01]"), ("apache-2", "apache 2 0"), ("artistic-1", "artistic 1 0"), ("artistic-2", "artistic 2 0"), ("blueoak-1", "blueoak 1 0 0"),
    ("bsd-2-clause", "bsd 2 clause"), ("bsd-3-clause", "bsd 3 clause"), ("bsd-4-clause", "bsd 4 clause"), ("bsl-1", "bsl 1 0"), ("busl-1.1", "busl 1 1"), ("cc0", "cc0 1 0"), ("cc-by", "cc by [1-4] [05]"), ("cc-by-sa", "cc by sa [1-4] [05]"),
    ("cc-by-nd", "cc by nd [1-4] [05]"), ("cc-by-nc", "cc by nc [1-4] [05]"), ("cc-by-nc-sa", "cc by nc sa [1-4] [05]"), ("cc-by-nc-nd", "cc by nc nd [1-4] [05]"), ("cddl-1", "cddl 1 [01]"), ("cecill-2", "cecill 2 [01]"), ("cpl-1", "cpl 1 0"),
    ("ecl-2", "ecl 2 0"), ("elastic-2", "elastic 2 0"), ("epl-1", "epl 1 0"), ("epl-2", "epl 2 0"), ("eupl", "eupl 1 [012]"), ("fdl-1", "gfdl 1 [123]"), ("gpl-2", "gpl 2 0"), ("gpl-3", "gpl 3 0"), ("hpnd", "hpnd"), ("isc", "isc"),
    ("lgpl-2", "lgpl 2 [01]"), ("lgpl-3", "lgpl 3 0"), ("lppl", "lppl 1 [0-3]c?"), ("mit", "mit"), ("mit-0", "mit 0"), ("mpl-1", "mpl 1 [01]"), ("mpl-2", "mpl 2 0"), ("ms-pl", "ms pl"), ("ms-rl", "ms rl"), ("ncsa", "ncsa"), ("odbl-1", "odbl 1 0"),
    ("ofl-1.1", "ofl 1 1"), ("openssl", "openssl"), ("osl-3", "osl 3 0"), ("php-3", "php 3 01?"), ("postgresql", "postgresql"), ("python-2", "(?:psf|python) 2 0"), ("qpl-1", "qpl 1 0"), ("ruby", "ruby"), ("sspl-1", "sspl 1 0"), ("unlicense", "unlicense"),
    ("upl-1", "upl 1 0"), ("vim", "vim"), ("wtfpl", "wtfpl"), ("zlib", "zlib"), ("zpl-2", "zpl 2 [01]"),
)
VERBS = ("licensed", "released", "distributed", "available", "published", "provided")


def rules() -> list[tuple[int, str, int, str, str, str, int, bool]]:
    """(rule, keyword, words before it, second keyword, pattern, label, priority, base): one row for each keyword."""
    found = [(word, back, second, words, label, 0, True) for label, word, back, second, words in PHRASES]
    found += [("spdx", 0, "identifier", f"spdx license identifier {name}(?: only| or later)?", label, TAG, False) for label, name in IDENTIFIERS]
    found += [(word, 0, second, words, label, SENTENCE, False) for label, second, word, words in SENTENCES]
    for label, priority, second, words, name in NAMES:
        found += [(verb, 0, second, f"{verb} under (?:the |an? )?(?:terms (?:and conditions )?of (?:the )?)?{name}", label, GRANT, False) for verb in VERBS]
        spoken = f" {LIC}" in name and f"(?: {LIC})?" not in name  # then that word is the rarer one
        found += [(word, 0, "licen" if spoken and second in word else second, name, label, priority, False) for word in words.split()]
    found += [("licensed", 0, "under", f"licensed under (?:the |an? )?(?:[^ ]+ ){{1,3}}?{LIC}", "other", SHORT, False)]
    return [(i, *r) for i, r in enumerate(found)]


RULES = rules()
RULE_COLUMNS = "rule int, keyword string, back int, second string, pattern string, label string, priority int, base boolean"


def gates() -> dict[str, list[str]]:
    """{keyword: second keywords of its rules}: a place near none of them is left out before any rule is joined."""
    seconds: dict[str, set[str]] = {}
    for _, word, _, second, *_ in RULES:
        seconds.setdefault(word, set()).add(second)
    return {word: sorted(s) for word, s in seconds.items()}


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, UPPER, LOWER), SEPARATORS), lambda w: w != "")


def places(words: Column) -> Column:
    """Places of keywords: at, lead (words before it in near), and near, the words around it."""
    asked = gates()
    gate = F.create_map(*(x for word, seconds in asked.items() for x in (F.lit(word), F.array(*map(F.lit, seconds)))))
    found = F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(*asked), i)))

    def around(i: Column) -> Column:
        lead = F.least(i, F.lit(BACK))
        return F.struct(i.alias("at"), lead.alias("lead"), words[i].alias("keyword"), F.array_join(F.slice(words, i - lead + 1, SPAN), " ").alias("near"))

    return F.filter(F.transform(found, around), lambda p: F.exists(gate[p["keyword"]], lambda second: F.contains(p["near"], second)))


def rule_table(spark: SparkSession) -> DataFrame:
    """The rules, a constant of some hundred short rows, for a broadcast."""
    return F.broadcast(spark.createDataFrame(RULES, RULE_COLUMNS))


def detections(texts: DataFrame) -> DataFrame:
    """(row, rule, label, priority, base, start, end) of all matches of all rules; ``texts``: row, places."""
    near = texts.select("row", F.explode("places").alias("p")).select("row", "p.*")
    tried = near.join(rule_table(texts.sparkSession), "keyword").where((F.col("lead") >= F.col("back")) & F.expr("contains(near, second)"))
    pattern = F.concat(F.lit("^(?:[^ ]+ ){"), F.col("lead") - F.col("back"), F.lit("}("), F.col("pattern"), F.lit(")(?: |$)"))
    met = tried.withColumn("met", F.call_function("regexp_extract", F.col("near"), pattern, F.lit(1))).where("met <> ''")
    start = F.col("at") - F.col("back")
    return met.select("row", "rule", "label", "priority", "base", start.alias("start"), (start + F.size(F.split("met", " "))).alias("end"))


def unsuppressed(found: DataFrame) -> DataFrame:
    """Detections that no stronger one contains."""
    upto = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("row", "priority").orderBy("start", F.col("end").desc(), "rule").rowsBetween(Window.unboundedPreceding, -1)
    stronger = F.coalesce(*(F.when(F.col("priority") == p, F.max(F.when(F.col("priority") > p, F.col("end"))).over(upto)) for p in WEIGHTS))
    marked = found.withColumn("stronger", stronger).withColumn("longer", F.max("end").over(before))
    return marked.where(F.greatest(F.coalesce("stronger", F.lit(0)), F.coalesce("longer", F.lit(0))) < F.col("end")).drop("stronger", "longer")


def license_labels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base (places of the phrases), first_word and last_word (their smallest and
    largest start), base_labels, labels (both sorted, comma-joined), score (the largest weight of what was found) and
    n_detections (those of the rules that were not suppressed).

    Null text has no words: no places, null first and last word, empty labels, score 0. Texts of any length are scanned
    whole. Of equal detections the earlier rule stays; rows repeated with one id get a row each; an empty table gives no
    rows; other columns are ignored.
    """
    with Scratch() as scratch:
        rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        seen = rows.select("row", "doc_id", let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), places(w).alias("places"))).alias("s"))
        texts = scratch.keep(stored(seen.select("row", "doc_id", "s.*"), "license-places"))
        found = stored(detections(texts.where(F.size("places") > 0)), "detections")
        base = F.col("base")
        all_kept = unsuppressed(found.where(~base)).unionByName(found.where(base))
        weight = F.when(base, BASE_WEIGHT).otherwise(F.create_map(*(F.lit(x) for pair in WEIGHTS.items() for x in pair))[F.col("priority")])
        labels = all_kept.groupBy("row").agg(
            F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
            F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
            F.max(weight).alias("score"), F.count_if(~base).alias("n_detections"),
        )
        labels = scratch.keep(stored(labels, "labels"))
    out = texts.drop("places").join(labels, "row", "left")
    none = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0), "n_detections": F.lit(0).cast("long")}
    return out.select("doc_id", "n_words", *(F.coalesce(c, none[c]).alias(c) if c in none else F.col(c) for c in ("n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_detections")))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def license_sql() -> str:
    """DuckDB SQL for the same rows; a detection is dropped where a stronger one that contains it exists."""
    values = ",\n".join(f"({rule}, {quoted(word)}, {back}, {quoted(second)}, {quoted(pattern)}, {quoted(label)}, {priority}, {base})" for rule, word, back, second, pattern, label, priority, base in RULES)
    weights = " ".join(f"WHEN {p} THEN {w}" for p, w in WEIGHTS.items())
    return f"""
WITH rules(rule, keyword, back, second, pattern, label, priority, base) AS (VALUES {values}),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SEPARATORS}'), lambda x: x <> '') AS w FROM documents),
hits AS (SELECT * FROM (SELECT doc_id, w, unnest(w) AS keyword, generate_subscripts(w, 1) - 1 AS i FROM d) SEMI JOIN rules USING (keyword)),
near AS (SELECT doc_id, keyword, i, least(i, {BACK}) AS led, w[greatest(i - {BACK}, 0) + 1 : greatest(i - {BACK}, 0) + {SPAN}] AS near FROM hits),
tried AS (SELECT n.doc_id, r.*, i - back AS s, regexp_extract(array_to_string(near[led - back + 1 :], ' '), '^(' || pattern || ')(?: |$)', 1) AS met FROM near n JOIN rules r USING (keyword) WHERE led >= back AND contains(array_to_string(near, ' '), second)),
found AS (SELECT *, s + len(string_split(met, ' ')) AS e FROM tried WHERE met <> ''),
held AS (SELECT * FROM found f WHERE base OR NOT EXISTS (SELECT 1 FROM found g WHERE g.doc_id = f.doc_id AND NOT g.base AND g.s <= f.s AND g.e >= f.e
  AND (g.priority > f.priority OR (g.priority = f.priority AND (g.e - g.s > f.e - f.s OR (g.e - g.s = f.e - f.s AND g.rule < f.rule)))))),
labels AS (SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(s) FILTER (WHERE base) AS first_word, max(s) FILTER (WHERE base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels,
  string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(CASE WHEN base THEN {BASE_WEIGHT} ELSE CASE priority {weights} END END) AS score, count(*) FILTER (WHERE NOT base) AS n_detections FROM held GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CAST(coalesce(score, 0) AS DOUBLE) AS score, CAST(coalesce(n_detections, 0) AS BIGINT) AS n_detections
FROM d LEFT JOIN labels l ON l.doc_id = d.doc_id
"""
