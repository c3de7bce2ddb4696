"""Countries of written places, by the parts of the text and tables of countries and towns; coordinates of towns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_of, fold
from ..functions.vocabulary import HINTS, NO_TOWNS, PLACE_NOISE, STATES
from .windows import top_per_group


def flat(text: Column) -> Column:
    return F.lower(fold(text))


def parts(place: Column) -> Column:
    """Pieces between commas, dashes, slashes, brackets, bars and colons, without words that name no place."""
    quiet = F.regexp_replace(flat(place), rf"(?<![\p{{L}}\p{{N}}])(?:{any_of(PLACE_NOISE)})(?![\p{{L}}\p{{N}}])", " ")
    return F.filter(F.transform(F.split(quiet, r"[,\-/()|:]"), lambda p: F.btrim(p)), lambda p: p != "")


def countries_of(df: DataFrame, id_column: str, place: str, countries: DataFrame, towns: DataFrame) -> DataFrame:
    """(id, country) of rows whose place tells a country; ``countries`` has name and code, ``towns`` name, country, population.

    In this order: a country's name that is no state's as well; a state's code after a comma (if the code is a country's
    too, that country if the town before lies in it); US, UK or UAE as a word; the whole text as a town; a state's name;
    the most populous town among the pieces of three letters and more. Of towns of one name the most populous counts.
    """
    names = countries.select(flat(F.col("name")).alias("name"), "code").distinct()
    ranked = towns.select(flat(F.col("name")).alias("town"), F.col("country").alias("code"), F.coalesce("population", F.lit(0)).cast("long").alias("people"))
    known = top_per_group(ranked, ["town"], [F.col("people").desc(), F.col("code")], 1)
    rows = df.where(F.length(F.btrim(place)) > 0).select(F.col(id_column).alias("id"), F.btrim(place).alias("place"))
    pieces = rows.select("id", F.explode(parts(F.col("place"))).alias("part"))
    state_names = list(STATES.values())

    by_name = pieces.where(~F.col("part").isin(*state_names)).join(names, F.col("part") == F.col("name")).select("id", F.lit(0).alias("step"), F.lit(0).cast("long").alias("people"), "code")
    state = rows.select("id", F.regexp_extract("place", r",\s*([A-Z]{2})(?![A-Za-z])", 1).alias("state"), F.regexp_extract("place", r"^(.*?),\s*[A-Z]{2}(?![A-Za-z])", 1).alias("before"))
    state = state.where(F.col("state").isin(*STATES))
    before = state.select("id", "state", F.explode(parts(F.col("before"))).alias("part")).join(known, (F.col("part") == F.col("town")) & (F.col("state") == F.col("code"))).select("id", "code").distinct()
    abroad = before.join(countries.select(F.col("code")).distinct(), "code", "left_semi").select("id", F.lit(1).alias("step"), F.lit(1).cast("long").alias("people"), "code")
    at_home = state.select("id", F.lit(1).alias("step"), F.lit(0).cast("long").alias("people"), F.lit("US").alias("code"))
    hint = F.regexp_replace(F.regexp_extract("place", r"(?<![\p{L}\p{N}])(U\.S\.A\.?|U\.S\.|USA|US|UK|UAE)(?![\p{L}\p{N}])", 1), r"\.", "")
    table = F.create_map(*[F.lit(x) for pair in HINTS.items() for x in pair])
    hinted = rows.select("id", F.lit(2).alias("step"), F.lit(0).cast("long").alias("people"), table[hint].alias("code")).where(F.col("code").isNotNull())
    whole = rows.select("id", flat(F.col("place")).alias("part")).join(known, F.col("part") == F.col("town")).select("id", F.lit(3).alias("step"), "people", "code")
    stated = pieces.where(F.col("part").isin(*state_names)).select("id", F.lit(4).alias("step"), F.lit(0).cast("long").alias("people"), F.lit("US").alias("code"))
    town = pieces.where((F.length("part") >= 3) & ~F.col("part").isin(*NO_TOWNS)).join(known, F.col("part") == F.col("town")).select("id", F.lit(5).alias("step"), "people", "code")

    found = by_name
    for more in (abroad, at_home, hinted, whole, stated, town):
        found = found.unionByName(more)
    best = top_per_group(found, ["id"], [F.col("step"), F.col("people").desc(), F.col("code")], 1)
    return best.select(F.col("id").alias(id_column), F.col("code").alias("country"))


def coordinates(df: DataFrame, city: str, country: str, towns: DataFrame) -> DataFrame:
    """``df`` with lat and lon of the most populous town of that name in the country; null where there is none."""
    keyed = towns.select(flat(F.col("name")).alias("__town"), F.upper("country").alias("__of"), "lat", "lon", F.coalesce("population", F.lit(0)).alias("__people"))
    best = top_per_group(keyed, ["__town", "__of"], [F.col("__people").desc(), F.col("lat"), F.col("lon")], 1).drop("__people")
    first = flat(F.btrim(F.element_at(F.split(F.col(city), ","), 1)))
    return df.withColumn("__town", first).withColumn("__of", F.upper(country)).join(best, ["__town", "__of"], "left").drop("__town", "__of")
